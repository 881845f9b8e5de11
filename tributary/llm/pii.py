"""Personal data: pattern spans, and terms that give protected entities away.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern. The method then
treats each such value as a protected entity. From the words around its mentions it estimates, over
the corpus, how strongly a term reveals an entity: the probability of the entity given the term, and
the information in bits that this is above the entity's own frequency. Terms beyond both thresholds
are spans too: generalised, or removed where they all but determine the entity.

Everything runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.native import let, running
from tributary.llm.scratch import keyed_by, written

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns. Repetitions are possessive and a run of characters is entered at its start only,
# which finds the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these has no match that counts.
HINTS = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]"}
TERM = r"[\p{L}\p{N}]{3,}"

#: Characters on each side of a mention in which terms count as its neighbours.
CONTEXT = 60
#: Different texts that must show a term beside an entity, and the disclosure thresholds.
SUPPORT, GENERALISE, REMOVE, LEAST_BITS = 3, 0.8, 0.95, 6.0
_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _matches(text: Column, pattern: Column, kind: int) -> Column:
    """(kind, start, end, value) of the matches in order, by code points."""

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: x["n"] + F.length(x["value"])), lambda s, n: s + n, F.lit(0))

        def spans(e: Column) -> Column:
            return F.transform(pairs, lambda x, i: F.struct(F.lit(kind).alias("kind"), (F.get(e, i) + x["n"]).alias("start"), F.get(e, i + 1).alias("end"), x["value"].alias("value")))

        return let(ends, spans)

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = let(found, lambda m: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda b, v: F.struct(F.length(b).alias("n"), v.alias("value"))))
    return let(pairs, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(v: Column) -> Column:
        return F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)

    def total(d: Column) -> Column:
        values = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: let(F.substring(d, -i, F.lit(1)).cast("int"), lambda v: F.when(i % 2 == 0, doubled(v)).otherwise(v)))
        return F.aggregate(values, F.lit(0), lambda s, x: s + x)

    return let(digits, lambda d: total(d) % 10 == 0)


def _counts(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's test."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda z: (F.length(z) <= 3) & (F.coalesce(z.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _passed(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _counts(kind, x["value"]))


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind and then by start; none for null."""
    t = F.coalesce(text, F.lit(""))
    parts = []
    for number, kind in enumerate(KINDS[:4]):
        parts.append(F.when(t.rlike(HINTS[kind]), _passed(_matches(t, F.lit(PATTERNS[kind]), number), kind)).otherwise(F.array().cast(_SPANS)))
    return F.concat(*parts)


def _neighbours(docs: DataFrame, text_col: str) -> DataFrame:
    """(entity, whole, term): each term once per entity and distinct whole text that shows it beside the entity.

    A word that the edge of the neighbourhood cuts is left out. ``term`` is null where there is none.
    """
    t = F.col("t")
    hint = t.rlike("|".join(HINTS.values()))
    spans = docs.select(F.col(text_col).alias("t")).filter(hint).select("t", F.explode(base_spans(t)).alias("s"))
    # One character more on each side: a word that starts there is cut.
    first = F.greatest(F.col("s.start") - (CONTEXT + 1), F.lit(0))
    left, right = F.substring(t, first + 1, F.col("s.start") - first), F.substring(t, F.col("s.end") + 1, F.lit(CONTEXT + 1))
    left = F.when(F.col("s.start") > CONTEXT, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.when(F.length(right) > CONTEXT, F.regexp_replace(right, r"[\p{L}\p{N}]++$", "")).otherwise(right)
    terms = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", left, right), F.lit(TERM), F.lit(0)))
    return spans.select(F.xxhash64("s.kind", F.lower("s.value")).alias("entity"), F.xxhash64("t").alias("whole"), F.explode_outer(terms).alias("term")).distinct()


#: So many terms beyond the thresholds are looked up in every row by a set; more are joined.
LISTED = 20_000


def revealing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The terms beyond the thresholds as (term, probability, bits, removed); none for an empty table.

    Everything is counted in different whole texts, so that exact copies of one text prove nothing.
    A term needs ``SUPPORT`` texts that show it beside one entity. Its probability is the share of
    its texts that do.
    """
    near = written(_neighbours(docs, text_col), "neighbours")
    mentions = near.groupBy("entity").agg(F.count_distinct("whole").alias("mentions"))
    pairs = near.filter("term is not null").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= SUPPORT)
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, probability double, bits double, removed boolean")
    terms = pairs.select("term").distinct()
    # Texts by term are summed before the join, so that a common word among the candidates costs one row a task.
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).groupBy(F.xxhash64("t").alias("whole")).agg(F.first("t").alias("t"))
    seen = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)))).alias("term"))
    # An inner join: a semi join would be pushed below the sum.
    spread = seen.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).join(terms, "term")
    n = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).distinct().count()
    p = F.col("both") / F.greatest("texts", "both")
    bits = F.log2(p * F.lit(float(max(n, 1))) / F.col("mentions"))
    scored = pairs.join(spread, "term").join(mentions, "entity").select("term", p.alias("probability"), bits.alias("bits"))
    best = scored.groupBy("term").agg(F.max("probability").alias("probability"), F.max_by("bits", "probability").alias("bits"))
    risky = best.filter((F.col("probability") >= GENERALISE) & (F.col("bits") >= LEAST_BITS))
    return written(risky.withColumn("removed", F.col("probability") >= REMOVE), "terms")


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """Every row as (row, spans, removed): the row itself as a struct, so that no names clash."""
    risky = revealing_terms(docs, text_col)
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    rows, spans, removed = docs.select(row), base_spans(text), F.array().cast("array<string>")
    listed = risky.limit(LISTED + 1).collect()
    if listed:
        if len(listed) <= LISTED:
            # few enough for every task to hold: each row is looked up where it is
            names = [r["term"] for r in listed]
            gone = [r["term"] for r in listed if r["removed"]]
            held = F.filter(tokens, lambda x: x.isin(names))
            rows = rows.withColumn("terms", held).withColumn("gone", F.filter("terms", lambda x: x.isin(gone)) if gone else removed)
        else:
            key = keyed_by(docs)
            whole = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
            rows = whole.select(F.col(key).alias("key"), row)
            seen = rows.select("key", F.explode(tokens).alias("term"))
            held = seen.join(risky, "term").groupBy("key").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"))
            rows = rows.join(held, "key", "left")
        some = F.coalesce(F.size("terms"), F.lit(0)) > 0
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        spans = F.concat(spans, F.when(some, _matches(text, pattern, 4)).otherwise(F.array().cast(_SPANS)))
        removed = F.coalesce("gone", removed)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return rows.select("row", ordered.alias("spans"), removed.alias("removed"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, ``spans`` (start, kind, end, value; base spans and terms) and ``removed_terms``.

    Offsets are code points, ends are exclusive, spans are ordered by start and then by kind. A null
    or empty text has none. Terms are matched as whole words, case and all, wherever they stand.
    Rows with a null id are searched like any other, repeated rows alike, and a very long text whole; an empty table gives an empty one.
    Other columns aren't read.
    """
    return _marked(docs.select(id_col, text_col), text_col).select(F.col(f"row.`{id_col}`").alias(id_col), "spans", F.col("removed").alias("removed_terms"))


def _label(span: Column, removed: Column) -> Column:
    out = None
    for number, kind in enumerate(KINDS[:4]):
        hit = span["kind"] == number
        out = F.when(hit, f"<{kind.upper()}>") if out is None else out.when(hit, f"<{kind.upper()}>")
    return out.when(F.array_contains(removed, span["value"]), "").otherwise("<TERM>")


def masked(text: Column, spans: Column, removed: Column) -> Column:
    """The text with each span replaced by its kind; of spans that overlap, the first one's kind stands for all."""

    def apart(ordered: Column) -> Column:
        # a span opens a new one unless one before it ends behind its start
        def opened(ends: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.get(ordered, i)["start"] >= F.get(ends, i))
            return let(first, lambda f: F.transform(f, lambda i, k: let(F.get(ordered, i), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), F.get(ends, F.coalesce(F.get(f, k + 1), F.size(ordered))).alias("end"), x["value"].alias("value")))))

        return let(running(F.transform(ordered, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0)), opened)

    def joined(s: Column) -> Column:
        pieces = F.transform(s, lambda x, i: let(F.coalesce(F.get(s, i - 1)["end"], F.lit(0)), lambda a: F.concat(F.substring(text, a + 1, x["start"] - a), _label(x, removed))))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(0)) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(apart(spans), joined))


def sanitised(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows with all columns as they were, but for the text, masked, and its length.

    A null text stays null; repeated rows are masked alike; an empty table gives an empty one.
    """
    found = _marked(docs, text_col).withColumn("masked", masked(F.col(f"row.`{text_col}`"), F.col("spans"), F.col("removed")))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("masked").alias(name)
        if name == length_col:
            return F.length("masked").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return found.select(*map(column, docs.columns))

"""Quality rules as a short-circuit cascade.

A rule is a test on measures of the text. On a sample, each rule's cost (steps) and selectivity
(share of rows that it rejects) are estimated; the rules are then tried in the order of rejection
per cost, and a row that one rejects is not measured for the rules behind it. The order decides only
what is computed and which rule is named, never what is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.native import let, words

WINDOW = 5
#: Rows of the sample that costs and selectivities are estimated on, about.
SAMPLE = 2000


def _covered(starts: Column) -> Column:
    """Words that lie in windows with the given first words, which are in order."""
    gaps = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)


def _repeated(w: Column) -> Column:
    """Words of ``w`` in windows that occur twice or more."""

    def found(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(placed, lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull()))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_covered(F.sort_array(twice)))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), found)))


def _count(text: Column, others: str) -> Column:
    """Characters that are left when those of the class ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measures(text: Column) -> dict[str, Column]:
    """Measures of a whole text by name; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = let(_lines(t), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "n_words": F.size(words(t)).cast("long"),
        "word_chars": F.length(F.array_join(words(t), "")).cast("long"),
        "n_symbols": _count(t, r"[^#*$%&|<>]++"),
        "n_lines": lines["n_lines"],
        "n_dup_lines": lines["n_dup_lines"],
        "n_repeat_words": let(words(t), _repeated),
        "n_upper": _count(t, "[^A-Z]++"),
        "n_letters": _count(t, "[^A-Za-z]++"),
    }


#: Measures that :func:`measured` has for every row.
BASIC = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the ``BASIC`` measures of every row, and its verdict column's input ``_t`` (the text, empty for null).

    Each list of words or lines is made once. A null or empty text has zeros; repeated rows are
    measured alike, a very long text whole; an empty table gives an empty one.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    own = measures(F.col("_t"))
    by_word = let(words(F.col("_t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    by_line = let(_lines(F.col("_t")), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(F.col(id_col), t.alias("_t")).select(F.col(id_col), "_t", by_word.alias("_w"), by_line.alias("_l"), own["n_symbols"].alias("n_symbols"))
    return rows.select(id_col, "_t", "_w.*", "_l.*", "n_symbols")


def judged(docs: DataFrame, order: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the ``BASIC`` measures and ``rejected_by`` of every row.

    What only the cascade's own rules need is measured inside the cascade, for rows that no earlier
    rule rejects. A null or empty text has zeros and is rejected by the word count; repeated rows and null ids are
    judged by their text, a very long text whole; an empty table gives an empty one. Other columns aren't read.
    """
    rows = measured(docs, id_col, text_col)
    values = measures(F.col("_t")) | {n: F.col(n) for n in BASIC}
    return rows.withColumn("rejected_by", verdict(values, order)).drop("_t")


@dataclass(frozen=True)
class Rule:
    """A name, the measures it needs and the test that rejects."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]

    def on(self, values: dict[str, Column]) -> Column:
        return self.rejects(*(values[n] for n in self.needs))


#: What the contract calls base rules, then the cascade's own.
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: r * 100 > n * 20),
)
OWN = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: s * 2 > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: d * 10 > n * 3),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < n * 2),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > n * 20),
    Rule("upper_case", ("n_upper", "n_letters"), lambda u, n: u * 2 > n),
)
RULES = (*BASE, *OWN)


#: Steps that a measure takes for each character, word and line of a text.
WORK = {
    "n_words": (1, 0, 0), "word_chars": (2, 0, 0), "n_symbols": (1, 0, 0), "n_lines": (1, 0, 0), "n_dup_lines": (1, 0, 4), "n_repeat_words": (1, 30, 0), "n_upper": (1, 0, 0), "n_letters": (1, 0, 0),
}


def ordered(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejection per cost, estimated on about ``sample`` rows in one job; of an empty table, as given.

    A rule's cost is the steps that its measures take (``WORK``) on the sample's characters, words and lines; its selectivity the
    share of the sample that it rejects. Ranks are whole powers of four and ties go by name. The same rows give the same order.
    """
    n = docs.count()
    if not n:
        return list(rules)
    drawn = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).sample(False, min(1.0, sample / n), seed=3)
    values = measures(F.col("text"))
    measured_ = drawn.select(F.length("text").alias("chars"), *[v.alias(k) for k, v in values.items()])
    known = {k: F.col(k) for k in values}
    shares = [F.avg(F.when(r.on(known), 1.0).otherwise(0.0)).alias(r.name) for r in rules]
    of = measured_.agg(F.avg("chars").alias("chars"), F.avg("n_words").alias("words"), F.avg("n_lines").alias("lines"), *shares).first()
    found = []
    for rule in rules:
        steps = sum(a * (of["chars"] or 0) + b * (of["words"] or 0) + c * (of["lines"] or 0) for a, b, c in (WORK[m] for m in rule.needs))
        rank = round(math.log(((of[rule.name] or 0.0) + 1e-4) / max(steps, 1.0), 4))
        found.append((-rank, rule.name, rule))
    return [rule for _, _, rule in sorted(found, key=lambda x: x[:2])]


def verdict(values: dict[str, Column], rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    out = None
    for rule in rules:
        hit = rule.on(values)
        out = F.when(hit, rule.name) if out is None else out.when(hit, rule.name)
    return out if out is not None else F.lit(None).cast("string")


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all columns as they were.

    A null or empty text has no words and is rejected by the word count; repeated rows are judged
    alike; a very long text is measured whole; an empty table gives an empty one.
    """
    return docs.filter(verdict(measures(F.col(text_col)), ordered(docs, text_col, rules)).isNull())

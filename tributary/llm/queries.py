"""The registered queries of the training-data operators: thin digests over their outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import chat, decontaminate, html, language, lines, lm, minhash, mixing, native, pii, quality, rules, runs, whitening
from tributary.llm.labels import labelled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents over 4-word shingles."""
    out = minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of ten benchmark words, and the items they come from."""
    found = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents, the base rules and the verdict of the cascade."""
    docs = _table(spark, sf_dir, "documents")
    order = rules.ordered(docs)
    base = rules.verdict({n: F.col(n) for n in rules.BASIC}, rules.BASE).isNotNull()
    found = rules.judged(docs, order).withColumn("base_failed", base).withColumn("kept", F.col("rejected_by").isNull())
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Domains of the labelled table and their target shares of the tokens.
TARGETS = {"good": 0.95, "poor": 0.03, "toxic": 0.02}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, domain) of a bounded sample of labelled documents: toxic ones, and the others by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labelled(docs, labels, ["toxic", "quality"]).select("text", domain.alias("domain"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents under which the labelled domains get their target shares."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.learn(labelled_domains(docs, _table(spark, sf_dir, "labels"))), TARGETS)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from ids and mask; one more holds control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(more)))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and a digest of the base spans, and all spans."""
    found = pii.find_personal(_table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def many(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select("doc_id", *map(many, range(4)), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labelled ones of two folds of three."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _fold(3) == 1)
    train = labelled(docs.filter("not held_out"), _table(spark, sf_dir, "labels").filter(_fold(3) != 1), ["quality"])
    return quality.score(docs, quality.fit(train), keep={"held_out": F.col("held_out")})


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those of two folds of three."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _fold(3) == 1)
    return language.predict(docs, language.fit(docs.filter("not held_out")), keep={"held_out": F.col("held_out")})


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and mixed-context log probabilities of all documents, learned from nine folds of ten and adapted along each text."""
    return lm.score(_table(spark, sf_dir, "documents"), _fold(10) == 0, rate=lm.ADAPT, refine=lm.REFINE)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them hold."""
    left = lines.drop_common_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 32 strongest components of their covariance, scaled to variance one."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), most=32, scale=64.0, offset=1_000_000)


def _with_run(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the crc32 of its id, gets a periodic end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.transform(F.slice(w, a + 1, n), lambda _, i: F.get(w, a + i % p))
        return F.when(n == 0, "").otherwise(F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " "))

    return docs.select("doc_id", F.when(h % 10 == 0, native.let(native.words(F.col("text")), planted)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, one in ten of which is given a run."""
    found = runs.periodic_runs(_with_run(_table(spark, sf_dir, "documents")), least=12)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_decontamination, op3_quality_rules, op4_source_mixing, op5_chat_formatting, op6_html_extraction, op7_pii, op8_quality_classifier, op9_language_id, op10_lm_scoring, op11_line_dedup, op12_embedding_whitening, op13_periodic_runs)}


_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz"


def _spans_sql(kind: int, pattern: str, test: str) -> str:
    """Matches of a pattern that pass a test, with their places: the text between them says where they are."""
    return rf"""select doc_id, {kind} as kind, a as start, a + length(v) as "end", v as value from (
 select doc_id, v, cast(sum(length(b)) over w + coalesce(sum(length(v)) over (partition by row order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as a
 from (select doc_id, row, unnest(m) as v, unnest(p[1:len(m)]) as b, unnest(range(len(m))) as k from (select doc_id, row, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p from d))
 window w as (partition by row order by k rows between unbounded preceding and current row)) where {test}"""


_RUN = r"[\p{L}\p{N}]+"
_LUHN = "list_sum(list_transform(range(length(g)), lambda i: case when i % 2 = 0 then cast(g[length(g) - i] as int) when cast(g[length(g) - i] as int) > 4 then 2 * cast(g[length(g) - i] as int) - 9 else 2 * cast(g[length(g) - i] as int) end)) % 10 = 0"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op11_line_dedup": rf"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
e as (select r, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_ASCII}') as key from (select r, unnest(l) as line, unnest(range(len(l))) as i from d)),
f as (select key from e where key <> '' group by key having count(distinct r) >= 10),
k as (select r, string_agg(line, chr(10) order by i) filter (f.key is null) as left_text, count(f.key) as n_dropped from e left join f using (key) group by r)
select doc_id, len(l) as n_lines, n_dropped, sha256(coalesce(left_text, '')) as kept_sha256 from d join k using (r)
""",
    "op13_periodic_runs": r"""
with c as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::bigint),
   lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384::bigint * (s & 1)))), 4294967295::bigint) as h from documents),
g as (select *, len(w) as n, h // 10 as g from c),
a as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from g),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
d as (select r, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) end as w from p),
t as (select r, unnest(w) as x, unnest(range(n)) as i from d),
e as (select u.r, v.i - u.i as p, u.i from t u join t v on u.r = v.r and u.x = v.x and u.i < v.i),
s as (select r, p, min(i) as start, count(*) + p as length from (select r, p, i, i - row_number() over (partition by r, p order by i) as k from e) group by r, p, k having count(*) >= greatest(p, 12 - p)),
q as (select r, start, length, min(p) as period from s group by r, start, length),
b as (select r, count(*) as n_runs, min({'l': -length, 's': start, 'p': period}) as b, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed from q group by r),
o as (select distinct r, unnest(range(start + period, start + length)) as i from q),
k as (select r, string_agg(x, ' ' order by i) as left_words from t anti join o using (r, i) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, -b.l as length, b.p as period, -1000 * b.l // b.p as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(left_words, '')) as collapsed_sha256
from d left join b using (r) left join k using (r)
""",
    "op1_minhash_near_dedup": rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ASCII}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 80 * (nx.n + ny.n - i)),
sym as (select x, y from e union all select y, x from e),
r as (select doc_id, doc_id as c from d union select r.doc_id, sym.y from r join sym on sym.x = r.c),
c as (select doc_id, min(c) as component_id from r group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d join c using (doc_id) left join n using (doc_id)
""",
    "op5_chat_formatting": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, length(text) + len(regexp_extract_all(text, '<<\\*/?SYS>>|<\\*/?(?:s|ROLE)>|\[\\*/?INST\]')) + case role when 'user' then 13 when 'assistant' then 4 when 'system' then 15
   else 17 + 4 + length(role) + len(regexp_extract_all(role, '<<\\*/?SYS>>|<\\*/?(?:s|ROLE)>|\[\\*/?INST\]')) end as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 length(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(3 + sum(chars) as bigint) as formatted_chars
from m group by conv_id
""",
    "op3_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(list_slice(w, i, i + 4), ' ')) as times
        from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from win where times > 1) group by doc_id),
m as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters
      from d left join rep using (doc_id)),
n as (select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols * 2 > n_words or n_dup_lines * 10 > n_lines * 3 or word_chars < n_words * 2 or word_chars > n_words * 20 or n_upper * 2 > n_letters) as kept
from n
""",
    "op7_pii": rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
base as ({_spans_sql(0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
 union all {_spans_sql(1, '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', "list_bool_and(list_transform(string_split(v, '.'), lambda x: try_cast(x as hugeint) <= 255))")}
 union all select * exclude g from (select *, regexp_replace(value, '[^0-9]', '', 'g') as g from ({_spans_sql(2, '[0-9](?:[ -]?[0-9])+', 'true')})) where length(g) between 12 and 19 and {_LUHN}
 union all {_spans_sql(3, '[+][0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) between 9 and 15')}),
ctx as (select distinct kind || ':' || lower(value) as entity, list_sort(list_distinct(regexp_extract_all(substring(t, cast(greatest(start - 60, 0) as int) + 1, cast(least(start, 60) as int)) || ' ' || substring(t, cast("end" as int) + 1, 60), '[\p{{L}}\p{{N}}]{{3,}}'))) as terms
  from base join d using (doc_id)),
mentions as (select entity, count(*) as mentions from ctx group by entity),
pairs as (select entity, term, count(*) as times from (select entity, unnest(terms) as term from ctx) group by 1, 2 having count(*) >= 3),
texts as (select term, count(*) as texts from (select unnest(list_distinct(regexp_extract_all(t, '[\p{{L}}\p{{N}}]{{3,}}'))) as term from d) where term in (select term from pairs) group by term),
scored as (select term, times / greatest(texts, times) as p, log2(times / greatest(texts, times) * (select count(*) from d) / mentions) as bits from pairs join texts using (term) join mentions using (entity)),
risky as (select term from scored group by term having max(p) >= 0.8 and arg_max(bits, p) >= 6),
found as (select * from base union all select * from ({_spans_sql(4, _RUN, 'v in (select term from risky)')}) where exists (select 1 from risky)),
named as (select doc_id, start, kind, (['email', 'ip', 'card', 'phone', 'term'])[kind + 1] || ':' || start || ':' || "end" as name from found)
select d.doc_id, count(*) filter (kind = 0) as n_email, count(*) filter (kind = 1) as n_ip, count(*) filter (kind = 2) as n_card, count(*) filter (kind = 3) as n_phone,
 sha256(coalesce(string_agg(name, ',' order by start, kind) filter (kind < 4), '')) as base_sha256, coalesce(string_agg(name, ',' order by start, kind), '') as spans
from d left join named using (doc_id) group by d.doc_id
""",
    "op2_decontamination": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ASCII}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{_ASCII}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bw as (select distinct item, least(len(w), 10) as n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as win
       from b, lateral (select unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i) where len(w) > 0),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hit as (select dw.doc_id, dw.i, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.win = bw.win),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
""",
}

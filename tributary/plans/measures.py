"""Queries over measures: aggregates by category, statistics files, scale factors, sequence numbers, metric texts and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import columns as C
from tributary.functions import sdp as D
from tributary.operators import quality as Q
from tributary.operators import relational as RL
from tributary.plans.registry import BD, query
from tributary.sources import bench as H
from tributary.sources import tables as S

CATEGORIES = {"1-URGENT": " Fast  Talk", "2-HIGH": "fast talk", "3-MEDIUM": "Sport", "4-NOT SPECIFIED": "", "5-LOW": " SPORT "}


@query(BD + ", ct as (select * from (values " + ", ".join(f"('{k}', '{' '.join(v.lower().split())}')" for k, v in CATEGORIES.items()) + """) as t(clip, category)), lb as (select br.*, unnest(case when category = '' then ['overall'] else ['overall', 'category:' || category] end) as label from br join ct using (clip))
select label, encoder, case when count(*) filter (status <> 'ok') = 0 then round(avg(case when status = 'ok' then gain end), 2) end as mean, count(*) as clips, count(*) filter (status <> 'ok') as failed from lb group by 1, 2""")
def bd_rate_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rate differences over all clips and by category."""
    points = S.rate_points(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    clips = points.select("clip").distinct().withColumn("category", F.try_element_at(names, F.col("clip")))
    return Q.bd_rate_categories(Q.bd_rate(points.select("clip", "encoder", "rate", "metric"), "A"), clips)


@query("""select event_id, 'clip ' || user_id || ',1280,720,,30,' || event_type || ',' || (event_id * 1000) || repeat(',', 8) || (event_id % 90) || repeat(',', 7) || (event_id * 3) || repeat(',', 5) || (event_id % 7) || repeat(',', 12) || case when event_id % 4 = 0 then 'error' else 'ok' end || ',' || case when event_id % 4 = 0 then '"a, b"' else '' end as line from events""")
def encoder_stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an encoder's statistics as they are written to a file."""
    e, bad = F.col("event_id"), F.col("event_id") % 4 == 0
    row = {"clip": F.concat(F.lit("clip "), "user_id"), "width": F.lit(1280), "height": F.lit(720), "fps": F.lit(30), "encoder": F.col("event_type"), "target_bps": e * 1000, "inter_blocks": e % 90, "luma_txbs": e * 3, "block_32x32": e % 7,
           "status": F.when(bad, "error").otherwise("ok"), "error": F.when(bad, "a, b")}
    return S.table(spark, sf_dir, "events").select("event_id", H.stats_line(row).alias("line"))


@query("""select l_orderkey, l_linenumber, case when l_linenumber * 100 * 2 >= cast(l_quantity as int) * 20 and l_linenumber * 100 <= cast(l_quantity as int) * 20 * 16 then cast((cast(l_quantity as int) * 20 * 16384 + l_linenumber * 50) // (l_linenumber * 100) as bigint) end as factor,
((l_orderkey * 977 - l_partkey * 31 + 32768) % 65536 + 65536) % 65536 - 32768 as distance from lineitem""")
def scale_and_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale factors of references of many sizes, and distances of sequence numbers that wrap."""
    reference, current = F.col("l_quantity").cast("int") * 20, F.col("l_linenumber") * 100
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.scale_factor_q14(reference, current).alias("factor"), C.seq_distance(F.col("l_orderkey") * 977, F.col("l_partkey") * 31).alias("distance"))


TEXTS = ["{}.5", "inf", "NaN", "-{}", "x{}", "", "1e400", " {} ", "-Infinity", "{}e-3"]


@query("""with t as (select event_id, (['{}.5', 'inf', 'NaN', '-{}', 'x{}', '', '1e400', ' {} ', '-Infinity', '{}e-3'])[event_id % 10 + 1] as s from events), v as (select event_id, try_cast(trim(replace(s, '{}', event_id::varchar)) as double) as v from t)
select event_id, case when isfinite(v) then v end as value from v""")
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric texts as numbers; those that aren't finite are null."""
    text = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("event_id") % len(TEXTS) + 1).cast("int"))
    rows = S.table(spark, sf_dir, "events").select("event_id", F.regexp_replace(text, r"\{\}", F.col("event_id").cast("string")).alias("text"))
    return rows.select("event_id", C.finite(F.col("text")).alias("value"))


_LEVELS = "(2, 3, 6, 7, 10, 11, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30)"


@query(f"""with p as (select event_id, event_id % 4 as p, event_id * 3 % 32 as l, case when event_id * 3 % 32 > 7 then event_id % 2 else 0 end as t, event_id * 5 % 3 as sp, event_id * 7 % 20 as sl from events),
q as (select *, case when sl > 7 then event_id // 2 % 2 else 0 end as st, p <= 2 and l not in {_LEVELS} and sl not in {_LEVELS} as ok from p)
select event_id, ok, case when ok then sp <= p and (sl < l or (sl = l and st <= t)) end as allows from q""")
def sdp_allows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parameters of a line, if sound, admit those of another."""
    e = F.col("event_id")
    level, stream = e * 3 % 32, e * 7 % 20
    own = F.concat(F.lit("profile="), e % 4, F.lit(";level-idx="), level, F.lit(";tier="), F.when(level > 7, e % 2).otherwise(0))
    sent = F.concat(F.lit("profile="), e * 5 % 3, F.lit(";level-idx="), stream, F.lit(";tier="), F.when(stream > 7, F.floor(e / 2) % 2).otherwise(0))
    rows = S.table(spark, sf_dir, "events").select("event_id", own.alias("own"), sent.alias("sent"))
    a, b = D.fmtp(F.col("own")), D.fmtp(F.col("sent"))
    both = rows.select("event_id", F.struct(*[v.alias(k) for k, v in a.items()]).alias("a"), F.struct(*[v.alias(k) for k, v in b.items()]).alias("b"))
    ok = F.col("a.ok") & F.col("b.ok")
    return both.select("event_id", ok.alias("ok"), F.when(ok, D.allows({k: F.col(f"a.{k}") for k in a}, {k: F.col(f"b.{k}") for k in b})).alias("allows"))


@query("""with p as (select p_brand as clip, p_type as encoder, cast(p_size as double) as metric, p_retailprice as rate from part), g as (select clip, encoder from p group by 1, 2 having count(distinct metric) = count(*))
select clip, encoder, metric, rate, row_number() over (partition by clip, encoder order by metric, rate) as place from p join g using (clip, encoder)""")
def rd_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the curves without a repeated metric, in order."""
    rows = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("clip"), F.col("p_type").alias("encoder"), F.col("p_size").cast("double").alias("metric"), F.col("p_retailprice").alias("rate"))
    return RL.accepted_curves(rows, ["clip", "encoder"])


@query("""with r as (select c_nationkey as nation, case when c_custkey % 9 = 0 then 'overall' else c_mktsegment end as label, count(*) as n from customer group by 1, 2)
select *, row_number() over (partition by nation order by label <> 'overall', label) as place from r""")
def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each group in their order: the whole first, then by name."""
    label = F.when(F.col("c_custkey") % 9 == 0, "overall").otherwise(F.col("c_mktsegment"))
    rows = S.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return RL.labelled_places(rows, "nation", "label").select("nation", "label", "n", "place")

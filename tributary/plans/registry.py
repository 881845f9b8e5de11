"""All queries of the package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary import session
from tributary.functions import columns as C
from tributary.functions import text as T
from tributary.operators import blocks as B
from tributary.operators import quality as Q
from tributary.operators import relational as RL
from tributary.operators import transport as R
from tributary.sources import containers as K
from tributary.sources import files as FS
from tributary.sources import rtcp as RC
from tributary.sources import tables as S
from tributary.streaming import state as ST

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pk(rest: str) -> str:
    return f"with {S.PACKETS}{rest}"


GAPS = ", d as (select ssrc, ext_seq, lag(ext_seq) over (partition by ssrc order by ext_seq) as before from rx), g as (select ssrc, before + 1 as first, ext_seq - before - 1 as length from d where ext_seq - before > 1) "


@query(_pk(""", m as (select ssrc, ext_seq, ext_seq - lag(ext_seq) over (partition by ssrc order by ext_seq) - 1 as missing from rx),
o as (select ssrc, count(*) as received, max(ext_seq) - min(ext_seq) + 1 as expected, count(*) filter (missing > 0) as gaps, coalesce(max(missing), 0) as longest_gap from m group by ssrc)
select *, expected - received as lost, round((expected - received) * 100.0 / expected, 6) as loss_pct from o"""))
def transport_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gap_report(S.received(spark, sf_dir))


@query(_pk(GAPS + "select ssrc, unnest(range(first, first + length)) as seq from g"))
def transport_missing_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_sequences(S.received(spark, sf_dir))


@query(_pk(" select ssrc, ext_seq, coalesce(ext_seq - lag(ext_seq) over (partition by ssrc order by ext_seq) > 1, false) as after_loss from rx"))
def transport_after_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.after_loss(S.received(spark, sf_dir))


@query(_pk(""", f as (select *, max(ext_seq) over (partition by ssrc order by arrival rows between unbounded preceding and 1 preceding) as furthest from arr),
o as (select ssrc, ext_seq, min(arrival) as arrival, arg_min(coalesce(ext_seq < furthest, false), arrival) as late, count(*) as copies from f group by 1, 2)
select *, row_number() over (partition by ssrc order by ext_seq) as position from o"""))
def transport_dedup_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reordered(S.arrivals(spark, sf_dir))


@query(_pk(""", w as (select *, case when seq - lag(seq) over (partition by ssrc order by event_id) < -32768 then 1 else 0 end as wrap from pk)
select ssrc, event_id, seq, cast(sum(wrap) over (partition by ssrc order by event_id) * 65536 + seq as bigint) as unwrapped from w"""))
def transport_seq_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unwrapped(S.packets(spark, sf_dir))


NACKS = """with recursive """ + S.PACKETS + """, p as (select ssrc, min(seq) as pid from lost group by ssrc
 union all select p.ssrc, min(l.seq) from p join lost l on l.ssrc = p.ssrc and l.seq > p.pid + 16 group by p.ssrc),
np as (select p.ssrc, p.pid, cast(coalesce(sum(1::bigint << cast(l.seq - p.pid - 1 as int)), 0) as bigint) as mask from p left join lost l on l.ssrc = p.ssrc and l.seq > p.pid and l.seq <= p.pid + 16 group by 1, 2) """


@query(NACKS + "select * from np")
def nack_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.packed_nacks(S.lost(spark, sf_dir))


@query(NACKS + "select ssrc, pid as seq from np union all select ssrc, pid + i + 1 from np, range(16) r(i) where (mask >> cast(i as int)) & 1 = 1")
def nack_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expanded_nacks(R.packed_nacks(S.lost(spark, sf_dir)))


@query(_pk(""", c as (select ssrc, ext_seq % 64 as slot, max(ext_seq) as seq, arg_max(size, ext_seq) as size from pk group by 1, 2)
select ssrc, seq, size, row_number() over (partition by ssrc order by seq) as rtx_seq from lost join c using (ssrc, seq)"""))
def rtx_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repaired(S.lost(spark, sf_dir), S.packets(spark, sf_dir))


TWCC = """, e as (select ssrc, unnest(range(min(ext_seq), max(ext_seq) + 1)) as ext_seq from rx group by ssrc),
s as (select ssrc, ext_seq, recv_us, coalesce(cast(floor((recv_us - lag(recv_us) over (partition by ssrc order by ext_seq)) / 250) as bigint), 0) as delta_ticks from rx),
fb as (select e.ssrc, e.ext_seq, recv_us is not null as received, delta_ticks from e left join s using (ssrc, ext_seq)) """


@query(_pk(TWCC + "select * from fb"))
def twcc_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.feedback(S.received(spark, sf_dir))


@query(_pk(TWCC + "select ssrc, ext_seq, cast(sum(delta_ticks) over (partition by ssrc order by ext_seq) * 250 as bigint) as at_us from fb where received"))
def twcc_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.timeline(R.feedback(S.received(spark, sf_dir)))


@query(_pk(TWCC + """select ssrc, count(*) filter (received) as received, count(*) filter (not received) as missing, min(ext_seq) filter (received) as first_seq, max(ext_seq) filter (received) as last_seq,
min(delta_ticks) as min_delta, max(delta_ticks) as max_delta from fb group by ssrc"""))
def twcc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.feedback_summary(R.feedback(S.received(spark, sf_dir)))


@query(_pk(""", r as (select event_id, least(greatest(size * 1000, 50000), 2500000) as target from pk)
select event_id, target, cast(floor(target / 6) as bigint) as layer0, cast(floor(target * 2 / 6) as bigint) as layer1, cast(target - floor(target / 6) - floor(target * 2 / 6) as bigint) as layer2 from r"""))
def remb_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clamped_bitrate(S.packets(spark, sf_dir), 50_000, 2_500_000)


@query("with recursive " + S.PACKETS + """, n as (select ssrc, ext_seq, size, row_number() over (partition by ssrc order by ext_seq) as i from pk),
b as (select ssrc, i, ext_seq, least(greatest(size - 1500, 0), 6000) as level from n where i = 1
 union all select n.ssrc, n.i, n.ext_seq, least(greatest(b.level + n.size - 1500, 0), 6000) from b join n on n.ssrc = b.ssrc and n.i = b.i + 1)
select ssrc, ext_seq, level from b""")
def cbr_buffer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.buffer_levels(S.packets(spark, sf_dir), 1500, 6000)


@query(f"with {S.UNITS}, m as (select *, cast(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id) as bigint) as session from ob) select user_id, session, count(*) as units, min(event_id) as first_unit, max(event_id) as last_unit from m group by 1, 2")
def cvs_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sessions(S.units(spark, sf_dir))


@query(f"""with {S.UNITS} select event_id, user_id, event_id % 8 as slot, last_value(case when event_type = 'purchase' then event_id end ignore nulls)
over (partition by user_id, event_id % 8 order by event_id rows between unbounded preceding and 1 preceding) as reference from ob""")
def ref_slot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.current_reference(S.units(spark, sf_dir))


@query("select epoch_us(time_bucket(interval '1 day', ts)) as start_us, event_type, count(*) as packets, cast(sum(cast(floor(value * 10) as bigint)) as bigint) as bytes from events group by 1, 2")
def time_window_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own time windows; the reference has none."""
    return R.window_rates(S.table(spark, sf_dir, "events"))


@query(f"with {S.UNITS} select t, s, count(*) as units from ob where type not in (1, 2, 5) group by t, s")
def layer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.units(spark, sf_dir).filter(~F.col("type").isin(1, 2, 5)).groupBy("t", "s").agg(F.count(F.lit(1)).alias("units"))


@query(f"with {S.UNITS} select event_type, string_agg(l, ',' order by l) as layers from (select distinct event_type, 'T' || t || 'S' || s as l from ob) group by event_type")
def layer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("T"), F.col("t"), F.lit("S"), F.col("s"))
    return S.units(spark, sf_dir).groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("layers"))


IDC = "(event_id * 40503) % 4096"


@query(f"with {S.UNITS}, i as (select *, {IDC} as idc from ob) select event_id, idc = 0 or ((idc >> cast(t as int)) & 1 = 1 and (idc >> cast(8 + s as int)) & 1 = 1) as matches, cast(bit_count(idc & 255) as int) as temporal_layers, cast(bit_count((idc >> 8) & 15) as int) as spatial_layers from i")
def operating_point_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.units(spark, sf_dir).withColumn("idc", F.expr(IDC))
    return rows.select("event_id", C.operating_point_matches(F.col("idc"), F.col("t"), F.col("s")).alias("matches"), F.bit_count(F.col("idc").bitwiseAND(F.lit(255))).alias("temporal_layers"), F.bit_count(F.shiftright("idc", 8).bitwiseAND(F.lit(15))).alias("spatial_layers"))


@query(f"with {S.UNITS}, i as (select *, case when event_id % 7 = 0 then null else {IDC} end as mask from ob) select event_id, t + 4 * s as target from i where (mask is null or (mask >> cast(t + 4 * s as int)) & 1 = 1) and type % 4 <> 0")
def decode_target_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.units(spark, sf_dir).withColumn("mask", F.expr(f"case when event_id % 7 = 0 then null else {IDC} end")).withColumn("target", F.col("t") + 4 * F.col("s"))
    active = F.coalesce(C.bit(F.col("mask"), F.col("target").cast("int")), F.lit(1)) == 1
    return rows.filter(active & (F.col("type") % 4 != 0)).select("event_id", "target")


@query("""select event_id, case when event_id > 0 then 2 - least(case when event_id % 2 = 1 then 0 when event_id % 4 = 2 then 1 else 2 end, 2) end as temporal_id,
case event_id % 4 when 0 then 0 when 2 then 1 else 2 end as pattern from events""")
def temporal_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return S.table(spark, sf_dir, "events").select("event_id", C.temporal_id(3, i).cast("int").alias("temporal_id"), F.when(i % 4 == 0, 0).when(i % 4 == 2, 1).otherwise(2).alias("pattern"))


def _bl(rest: str) -> str:
    return f"with {S.BLOCKS}{rest}"


ERR = """, df as (select vec_id, a, b, list_transform(list_zip(a, b), lambda t: t[1] - t[2]) as d from pr),
st as (select vec_id, cast(list_sum(list_transform(d, lambda x: x * x)) as bigint) as sse, cast(list_sum(list_transform(d, lambda x: abs(x))) as bigint) as sad, cast(list_sum(d) as bigint) as s,
 cast(list_min(list_transform(d, lambda x: abs(x))) as int) as min_diff, cast(list_max(list_transform(d, lambda x: abs(x))) as int) as max_diff from df) """


def _stat(name: str, *more: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return B.statistics(S.block_pairs(spark, sf_dir)).select("vec_id", *more)

    run.__name__ = name
    return run


query(_bl(ERR + "select vec_id, sse from st"))(_stat("block_sse", "sse"))
query(_bl(ERR + "select vec_id, sad from st"))(_stat("block_sad", "sad"))
query(_bl(ERR + "select vec_id, sse - ((s * s) >> 6) as variance from st"))(_stat("block_variance", "variance"))
query(_bl(ERR + "select vec_id, case when sse = 0 then 99.0 else round(10 * log10(4161600.0 / sse), 6) end as psnr from st"))(_stat("block_psnr", "psnr"))
query(_bl(ERR + "select vec_id, min_diff, max_diff from st"))(_stat("block_minmax", "min_diff", "max_diff"))


@query(_bl(ERR + """, cf as (select vec_id, u, sum(d[i + 1] * case when bit_count(cast(i & u as int)) % 2 = 0 then 1 else -1 end) as c from df, range(64) r(i), range(64) q(u) group by vec_id, u)
select vec_id, cast(sum(abs(c)) as bigint) as satd from cf group by vec_id"""))
def block_hadamard_satd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_pairs(spark, sf_dir).select("vec_id", B.satd("a", "b").alias("satd"))


def _listed(column) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(_bl(ERR + "select vec_id, array_to_string(list_transform(list_zip(a, d), lambda t: least(greatest(t[1] + t[2], 0), 255)), ',') as samples from df"))
def block_residual_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_pairs(spark, sf_dir).select("vec_id", _listed(B.residual_added("a", B.difference("a", "b"))).alias("samples"))


@query(_bl(" select vec_id, array_to_string(list_transform(list_zip(a, b, range(64)), lambda t: (t[3] * t[1] + (64 - t[3]) * t[2] + 32) >> 6), ',') as samples from pr"))
def block_blend_a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_pairs(spark, sf_dir).select("vec_id", _listed(B.blended("a", "b", F.sequence(F.lit(0), F.lit(63)))).alias("samples"))


@query(_bl(ERR + "select vec_id, array_to_string(list_transform(d, lambda x: (x + 4) >> 3), ',') as samples from df"))
def block_round_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_pairs(spark, sf_dir).select("vec_id", _listed(B.round_shifted(B.difference("a", "b"), 3)).alias("samples"))


@query(_bl(" select vec_id, array_to_string(list_transform(list_zip(a, b), lambda t: (t[1] + t[2] + 1) >> 1), ',') as samples from pr"))
def block_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_pairs(spark, sf_dir).select("vec_id", _listed(B.averaged("a", "b")).alias("samples"))


@query(_bl(" select vec_id, array_to_string(list_transform(range(16), lambda i: (q[(i // 4) * 16 + (i % 4) * 2 + 1] + q[(i // 4) * 16 + (i % 4) * 2 + 2] + q[(i // 4) * 16 + (i % 4) * 2 + 9] + q[(i // 4) * 16 + (i % 4) * 2 + 10] + 2) >> 2), ',') as samples from bl"))
def block_downscale_2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir).select("vec_id", _listed(B.halved("q")).alias("samples"))


@query(_bl(" select vec_id, array_to_string(list_transform(range(100), lambda i: q[least(greatest(i // 10 - 1, 0), 7) * 8 + least(greatest(i % 10 - 1, 0), 7) + 1]), ',') as samples from bl"))
def block_border_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir).select("vec_id", _listed(B.bordered("q")).alias("samples"))


@query(_bl(ERR + "select vec_id, array_to_string(list_transform(list_zip(d, range(64)), lambda t: case when t[1] < 0 then -least(((abs(t[1]) * case when t[2] = 0 then 40 else 48 end) & 16777215) >> 1, 32768) else least(((abs(t[1]) * case when t[2] = 0 then 40 else 48 end) & 16777215) >> 1, 32767) end), ',') as samples from df"))
def dequant_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_pairs(spark, sf_dir).select("vec_id", _listed(B.dequantised(B.difference("a", "b"), 40, 48, 1)).alias("samples"))


@query(_bl(""", o as (select x.vec_id, k as back, cast(list_sum(list_transform(list_zip(x.q, y.q), lambda t: abs(t[1] - t[2]))) as bigint) as sad from bl x, range(1, 9) r(k), bl y where y.vec_id = x.vec_id - k)
select vec_id, min(sad) as sad, cast(arg_min(back, sad * 100 + back) as int) as back from o group by vec_id"""))
def block_me_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_references(S.blocks(spark, sf_dir))


def _rp(rest: str) -> str:
    return f"with {S.POINTS}{rest}"


@query(_rp(" select c.clip, c.encoder, c.target, round(c.rate, 4) as rate, c.metric, round(a.rate, 4) as anchor_rate, a.metric as anchor_metric from rp c join rp a on a.clip = c.clip and a.target = c.target and a.encoder = 'A' where c.encoder <> 'A'"))
def rd_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.curve_pairs(S.rate_points(spark, sf_dir), "A")


def bd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bd_rate(S.rate_points(spark, sf_dir), "A")


def bd_rate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bd_rate_groups(Q.bd_rate(S.rate_points(spark, sf_dir), "A"))


QUERIES["bd_rate"], QUERIES["bd_rate_groups"] = bd_rate, bd_rate_groups


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + "".join(("+" if k % 2 == 0 else "-") + f"{m[0][k]}*{_det([[r[j] for j in range(len(m)) if j != k] for r in m[1:]])}" for k in range(len(m))) + ")"


def _curve(p: str) -> str:
    n = [[f"{p}s{i + j}" for j in range(4)] for i in range(4)]
    area = " + ".join(f"(pow(hi, {k + 1}) - pow(lo, {k + 1})) / {k + 1} * {_det([[f'{p}t{i}' if j == k else n[i][j] for j in range(4)] for i in range(4)])} / {_det(n)}" for k in range(4))
    return f"({area})"


def _powers(p: str) -> str:
    return ", ".join([f"count(*) as {p}n", *[f"sum(pow(x, {i})) as {p}s{i}" for i in range(7)], *[f"sum(pow(x, {i}) * y) as {p}t{i}" for i in range(4)]])


BD = _rp(f""", rg as (select c.clip, c.encoder, greatest(min(a.metric), min(c.metric)) as low, least(max(a.metric), max(c.metric)) as high, least(min(a.metric), min(c.metric)) as l, greatest(max(a.metric), max(c.metric)) as h
  from rp c join rp a on a.clip = c.clip and a.encoder = 'A' where c.encoder <> 'A' group by 1, 2),
xs as (select clip, encoder, low, high, (l + h) / 2 as centre, (h - l) / 2 as scale from rg),
cc as (select clip, encoder, {_powers('c')} from (select clip, encoder, (metric - centre) / scale as x, ln(rate) as y from rp join xs using (clip, encoder)) group by 1, 2),
aa as (select clip, encoder, {_powers('a')} from (select xs.clip, xs.encoder, (metric - centre) / scale as x, ln(rate) as y from rp join xs on rp.clip = xs.clip and rp.encoder = 'A') group by 1, 2),
bd as (select clip, encoder, low, high, (low - centre) / scale as lo, (high - centre) / scale as hi, cc.* exclude (clip, encoder), aa.* exclude (clip, encoder) from xs join cc using (clip, encoder) join aa using (clip, encoder)),
fl as (select clip, encoder, min(rate) <= 0 as bad, count(distinct metric) < count(*) as twice from rp group by 1, 2),
br as (select clip, encoder, low, high, case when an < 4 or cn < 4 then 'too few points' when f.bad or g.bad then 'invalid point' when f.twice or g.twice then 'repeated metric' when high <= low then 'no overlap' else 'ok' end as status, round((exp(({_curve('c')} - {_curve('a')}) / (hi - lo)) - 1) * 100, 3) as gain from bd join fl f using (clip, encoder) join fl g on g.clip = bd.clip and g.encoder = 'A') """)
ORACLE_SQL["bd_rate"] = BD + "select clip, encoder, low, high, case when status = 'ok' then gain end as bd_rate, status from br"
ORACLE_SQL["bd_rate_groups"] = BD + "select coalesce(encoder, 'all') as encoder, case when count(*) filter (status <> 'ok') = 0 then round(avg(case when status = 'ok' then gain end), 2) end as mean, count(*) as clips, count(*) filter (status <> 'ok') as failed from br group by grouping sets ((encoder), ())"


@query("""with r as (select p_brand, p_retailprice, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part),
o as (select p_brand, min(p_retailprice) as low, max(p_retailprice) filter (i = n // 4) as q1, max(p_retailprice) filter (i = n // 2) as median, max(p_retailprice) filter (i = n * 3 // 4) as q3, max(p_retailprice) as high from r group by p_brand)
select *, round(q3 - q1, 6) as iqr from o""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.order_statistics(S.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice")


@query("""with j as (select s_nationkey as k, round(avg(s_acctbal), 2) as goal from supplier group by 1), c as (select c_nationkey as k, c_custkey as level, c_acctbal as value from customer),
r as (select k, goal, level, round(abs(value - goal), 9) as gap, row_number() over (partition by k order by round(abs(value - goal), 9), value > goal, level) as n from j join c using (k))
select k, goal, level, gap from r where n = 1""")
def sweep_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = S.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 2).alias("goal"))
    return Q.nearest(jobs, S.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("level"), F.col("c_acctbal").alias("value")), ["k"])


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = S.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return Q.missing(S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), urgent.select(F.col("o_custkey").alias("k")), ["k"])


@query("select p_size, count(distinct nullif(lower(trim(p_type)), '')) as kinds, count(distinct nullif(lower(trim(p_type)), '')) >= 4 as diverse from part group by p_size")
def corpus_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.trim("p_type"))
    kinds = F.count_distinct(F.when(name != "", name))
    return S.table(spark, sf_dir, "part").groupBy("p_size").agg(kinds.alias("kinds"), (kinds >= 4).alias("diverse"))


@query("select p_partkey, lower(trim(regexp_replace('  ' || p_type || chr(9) || ' ' || p_name, '\\s+', ' ', 'g'))) as category from part")
def manifest_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").select("p_partkey", T.normal_category(F.concat(F.lit("  "), "p_type", F.lit("\t "), "p_name")).alias("category"))


@query("select o_orderpriority, o_orderstatus, count(*) as runs, count(distinct md5(cast(o_custkey % 7 as varchar))) as digests, count(distinct md5(cast(o_custkey % 7 as varchar))) <= 1 as same from orders group by 1, 2")
def determinism_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.deterministic(S.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], F.md5((F.col("o_custkey") % 7).cast("string").cast("binary")))


@query("select doc_id, case when n_chars < 128 then 1 when n_chars < 16384 then 2 when n_chars < 2097152 then 3 else 4 end as coded_bytes from documents")
def leb128_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", C.leb128_length(F.col("n_chars")).alias("coded_bytes"))


@query("""with v as (select event_id, (event_id * 2654435761) % 4294967296 as value from events), g as (select event_id, value, case when value < 128 then 1 when value < 16384 then 2 when value < 2097152 then 3 when value < 268435456 then 4 else 5 end as n from v)
select event_id, value, array_to_string(list_transform(range(n), lambda i: ((value >> cast(7 * i as int)) & 127) + case when i < n - 1 then 128 else 0 end), ',') as coded from g""")
def leb128_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 2654435761) % 4294967296).alias("v")).withColumn("b", C.leb128_bytes(F.col("v")))
    return rows.select("event_id", C.leb128_value(F.col("b")).alias("value"), _listed("b").alias("coded"))


@query("""with d as (select doc_id, octet_length(encode(text)) as size from documents), f as (select doc_id, size, greatest(cast(ceil(size / 1199) as bigint), 1) as n from d), e as (select doc_id, size, n, unnest(range(n)) as i from f)
select doc_id, i * 1199 as "offset", least(size - i * 1199, 1199) as length, i = 0 as first, i = n - 1 as last from e""")
def mtu_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.fragments(F.octet_length("text").cast("long"), 1200)).alias("f"))
    return rows.select("doc_id", "f.*")


@query("""select event_id, event_id % 64 >> 2 as primary_strength, case event_id % 4 when 3 then 4 else event_id % 4 end as secondary_strength,
((event_id * 7 - (event_id * 13) % 128 + 64) % 128 + 128) % 128 - 64 as hint_distance, least(greatest(event_id % 256 + (event_id % 97) - 48, 0), 255) as q_index from events""")
def header_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    first, second = C.cdef_strength((i % 64))
    return S.table(spark, sf_dir, "events").select("event_id", first.cast("long").alias("primary_strength"), second.cast("long").alias("secondary_strength"), C.order_hint_distance(i * 7, (i * 13) % 128, 7).cast("long").alias("hint_distance"), C.clamp(i % 256 + i % 97 - 48, 0, 255).cast("long").alias("q_index"))


@query("""select event_id, x, case when x % 2 = 0 then x when x > 0 then x - 1 else x + 1 end as lowered, case when x < 0 then -(((abs(x) + 3) >> 3) << 3) else ((abs(x) + 3) >> 3) << 3 end as whole,
(x - (x & 7)) // 8 as origin, x & 7 as part from (select event_id, event_id % 201 - 100 as x from events)""")
def motion_vector_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 201 - 100).alias("x"))
    x = F.col("x")
    return rows.select("event_id", "x", C.lower_mv_precision(x).alias("lowered"), C.lower_mv_precision(x, True).alias("whole"), F.shiftright(x, 3).alias("origin"), x.bitwiseAND(F.lit(7)).alias("part"))


#: Bytes of a file or stream, about; longer ones are written as several.
FILE = 64 << 20


@query("""select source, cast(row_number() over (partition by source order by doc_id) - 1 as int) as idx, doc_id * 3000 as pts, octet_length(encode(text)) as size, md5(text) as digest from documents""")
def ivf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as the frames of a file per source, and read back.

    Files go through the data source, cut at 64 MB, so that none has to fit into a cell. Rows that no frame can carry, those
    without a text or without a time of zero or more, take their places in the order beside the frames.
    """
    path = session.shared_folder(FS.register(spark), "ivf_roundtrip")
    name, later = F.coalesce(F.md5("source"), F.lit("none")), F.col("pts").asc_nulls_last()
    docs = S.table(spark, sf_dir, "documents").select("source", (F.col("doc_id") * 3000).alias("pts"), F.encode("text", "utf-8").alias("payload"))
    framed = F.col("payload").isNotNull() & F.coalesce(F.col("pts") >= 0, F.lit(False))
    rows = docs.filter(framed).select(name.alias("file"), "pts", "payload").repartition("file").sortWithinPartitions("file", "pts")
    rows.write.format("ivf").option("width", 64).option("height", 64).option("den", 90000).option("num", 1).option("file_bytes", FILE).mode("append").save(path)
    part = lambda k: F.regexp_extract("path", r"([^/-]*)-[0-9a-f]{8}-\d+-(\d+)\.ivf$", k)
    found = spark.read.format("ivf").load(path).select(part(1).alias("file"), "pts", part(2).cast("int").alias("number"), "idx", F.octet_length("payload").cast("long").alias("size"), F.md5("payload").alias("digest"))
    frames = found.join(docs.select("source", name.alias("file")).distinct(), "file").drop("file")
    none = F.lit(None).cast("int")
    bare = docs.filter(~framed).select("source", "pts", none.alias("number"), none.alias("idx"), F.octet_length("payload").cast("long").alias("size"), F.md5("payload").alias("digest"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(later, "number", "idx")) - 1
    return frames.unionByName(bare).select("source", place.cast("int").alias("idx"), "pts", "size", "digest")


UNIT_ROWS = f"""with {S.UNITS}, k as (select user_id, event_id, case when type = 2 then 3 else type end as type, t, s, event_type from ob)
select user_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as idx, cast(type as int) as type, cast(t as int) as temporal_id, cast(s as int) as spatial_id, event_type as payload from k"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.units(spark, sf_dir).select("user_id", "event_id", F.when(F.col("type") == 2, 3).otherwise(F.col("type")).alias("type"), "t", "s", F.encode("event_type", "utf-8").alias("payload"))
    return K.segmented(rows, ["user_id"], "event_id", F.octet_length("payload").cast("long") + 8, FILE)


@query(UNIT_ROWS)
def low_overhead_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units written as one stream per user, and read back."""
    rows = K.low_overhead_units(K.low_overhead_stream(_coded(spark, sf_dir), ["user_id", "segment", "first"], "event_id"))
    return rows.select("user_id", (F.col("first") + F.col("idx")).alias("idx"), "type", "temporal_id", "spatial_id", F.decode("payload", "utf-8").alias("payload"))


@query(UNIT_ROWS)
def annexb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units written length by length, and read back."""
    rows = K.annexb_units(K.annexb_stream(_coded(spark, sf_dir), ["user_id", "segment", "first"], "event_id"))
    return rows.select("user_id", (F.col("first") + F.col("idx")).alias("idx"), "type", "temporal_id", "spatial_id", F.decode("payload", "utf-8").alias("payload"))


@query(UNIT_ROWS.replace("select user_id, cast(row", "select user_id, cast((row_number() over (partition by user_id order by event_id) - 1) // 10 as int) as temporal_unit, cast(row", 1))
def annexb_temporal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units written as temporal units of ten, and read back."""
    coded = _coded(spark, sf_dir).withColumn("ten", F.floor(F.col("place") / 10)).drop("segment", "first")
    parts = K.segmented_units(coded, ["user_id"], "ten", F.octet_length("payload").cast("long") + 8, FILE)
    rows = K.annexb_units(K.annexb_stream(parts, ["user_id", "segment", "first", "first_unit"], "event_id", "ten"))
    return rows.select("user_id", (F.col("first_unit") + F.col("temporal_unit")).alias("temporal_unit"), (F.col("first") + F.col("idx")).alias("idx"), "type", "temporal_id", "spatial_id", F.decode("payload", "utf-8").alias("payload"))


@query(UNIT_ROWS)
def annexb_to_low_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-delimited streams turned into low-overhead ones, and read back."""
    keys = ["user_id", "segment", "first"]
    streams = K.annexb_as_low_overhead(K.annexb_stream(_coded(spark, sf_dir), keys, "event_id"), keys)
    return K.low_overhead_units(streams).select("user_id", (F.col("first") + F.col("idx")).alias("idx"), "type", "temporal_id", "spatial_id", F.decode("payload", "utf-8").alias("payload"))


@query(_pk(" select event_id, event_id % 5 = 0 as marker, cast(96 + event_id % 4 as int) as payload_type, cast(seq as int) as seq, (event_id * 3000) % 4294967296 as timestamp, ssrc, event_type as payload from pk"))
def rtp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written and read back."""
    i = F.col("event_id")
    coded = S.packets(spark, sf_dir).select("event_id", K.rtp_bytes(i % 5 == 0, 96 + i % 4, F.col("seq"), (i * 3000) % 4294967296, F.col("ssrc"), F.encode("event_type", "utf-8")).alias("content"))
    return K.rtp_packets(coded).select("event_id", "marker", "payload_type", "seq", "timestamp", "ssrc", F.decode("payload", "utf-8").alias("payload"))


@query(NACKS + "select ssrc as media_ssrc, cast(pid % 65536 as int) as pid, cast(mask as int) as mask from np")
def rtcp_nack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss pairs of each stream in feedback packets of at most some sixty pairs, and read back."""
    pairs = R.packed_nacks(S.lost(spark, sf_dir)).groupBy("ssrc", F.floor(F.col("pid") / 1024)).agg(F.array_sort(F.collect_list(F.struct((F.col("pid") % 65536).alias("pid"), "mask"))).alias("pairs"))
    coded = pairs.select(RC.nack_bytes(F.col("pairs"), F.lit(1), F.col("ssrc")).alias("content"))
    return RC.rtcp_packets(coded).select("media_ssrc", F.explode("nacks").alias("n")).select("media_ssrc", "n.pid", "n.mask")


#: One arrival a step. ``g`` are the packets held and the one that came; the window moves to the first number that isn't held and has
#: no packet eight or more ahead of it, and what lies before is released.
REORDER = S.PACKETS.replace("pk as", "recursive pk as", 1) + """, st as (select ssrc, ext_seq, size, row_number() over (partition by ssrc order by arrival) as i from arr), n as (select ssrc, count(*) as n from st group by 1),
w as (select distinct ssrc, cast(0 as bigint) as i, cast(null as bigint) as next, cast([] as bigint[]) as held, cast([] as bigint[]) as done, cast(null as bigint) as was from st union all
 select ssrc, i, nn, list_filter(g, lambda x: x >= nn), list_sort(list_filter(g, lambda x: x < nn)), now from (
  select *, list_min(list_filter(list_concat([now], list_transform(g, lambda x: x + 1)), lambda c: not list_contains(g, c) and coalesce(list_max(g), c) - c < 8 or list_max(g) < c)) as nn from (
   select w.ssrc, st.i, coalesce(w.next, st.ext_seq) as now, case when st.ext_seq < coalesce(w.next, st.ext_seq) or list_contains(w.held, st.ext_seq) then w.held else list_append(w.held, st.ext_seq) end as g from w join st on st.ssrc = w.ssrc and st.i = w.i + 1))),
o as (select ssrc, i, unnest(done) as ext_seq, was, done from w union all select w.ssrc, w.i + 1, unnest(list_sort(held)), next, list_sort(held) from w join n on n.ssrc = w.ssrc and n.n = w.i)
select o.ssrc, o.ext_seq, pk.size, o.ext_seq <> o.was and not list_contains(o.done, o.ext_seq - 1) as after_loss from o join pk on pk.ssrc = o.ssrc and pk.ext_seq = o.ext_seq"""


@query("with " + REORDER)
def stream_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals put in order through a window of eight slots, as the stateful stream does it."""
    return ST.reordered_batch(S.arrivals(spark, sf_dir), 8)


@query(f"with {S.UNITS} select user_id, event_type, min(event_id) as first_seen from ob group by 1, 2")
def first_seen_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.first_seen(S.units(spark, sf_dir), ["user_id", "event_type"], "event_id")


@query(_pk(" select ssrc, ext_seq, count(*) as times from arr group by 1, 2 having count(*) > 1"))
def duplicate_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.repeated(S.arrivals(spark, sf_dir), ["ssrc", "ext_seq"])


@query(_pk(""", w as (select *, sum(size) over (partition by ssrc order by ext_seq) - size as before, sum(size) over (partition by ssrc) as total from pk)
select ssrc, ext_seq, size, least(cast(floor(before * 4 / greatest(total, 1)) as bigint), 3) as batch from w"""))
def job_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.balanced(S.packets(spark, sf_dir).select("ssrc", "ext_seq", "size"), ["ssrc"], "ext_seq", "size", 4)


@query(_pk(" select event_id, size, cast(floor(size * 5 / 10) as bigint) as layer0, cast(floor(size * 3 / 10) as bigint) as layer1, cast(size - floor(size * 5 / 10) - floor(size * 3 / 10) as bigint) as layer2 from pk"))
def layer_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.temporal_layer_budget(S.packets(spark, sf_dir).select("event_id", "size"), "size", [5, 3, 2])


@query(_rp(" select clip, encoder, metric, round(rate, 4) as rate, row_number() over w as place, coalesce(metric = lag(metric) over w, false) as repeats from rp window w as (partition by clip, encoder order by metric, rate)"))
def rd_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.curve_points(S.rate_points(spark, sf_dir), ["clip", "encoder"]).withColumn("rate", F.round("rate", 4))


@query(f"""with {S.UNITS}, e as (select user_id as stream, event_id as picture, t = 0 or event_id % 3 = 0 as eligible from ob),
k as (select *, sum(cast(eligible as int)) over (partition by stream order by picture) - 1 as turn from e)
select stream, picture, eligible, case when eligible then cast((turn % 10) * 13 as bigint) end as start, case when eligible then cast(least((turn % 10) * 13 + 13, 130) as bigint) end as "end" from k""")
def cyclic_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = S.units(spark, sf_dir).select(F.col("user_id").alias("stream"), F.col("event_id").alias("picture"), ((F.col("t") == 0) | (F.col("event_id") % 3 == 0)).alias("eligible"))
    return RL.super_block_refresh(pictures, 130, 10)


@query("""select coalesce(c_mktsegment, 'all') as segment, coalesce(cast(c_nationkey as varchar), 'all') as nation, count(*) as n, round(avg(c_acctbal), 4) as mean, grouping(c_mktsegment) + 2 * grouping(c_nationkey) as level
from customer group by cube (c_mktsegment, c_nationkey)""")
def summary_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own cube over two dimensions; the reference has overall and per-category rows only."""
    out = S.table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), (F.grouping("c_mktsegment") + 2 * F.grouping("c_nationkey")).cast("long").alias("level"))
    return out.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("all")).alias("nation"), "n", "mean", "level")


# Further queries, which register themselves.
from tributary.plans import bench, description, measures, payload, streams  # noqa: E402, F401

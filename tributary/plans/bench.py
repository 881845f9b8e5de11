"""Queries over benchmark files, layer modes, scalars, references and pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import modes as M
from tributary.operators import blocks as B
from tributary.operators import quality as Q
from tributary.operators import transport as R
from tributary.plans.registry import query
from tributary.sources import bench as H
from tributary.sources import containers as K
from tributary.sources import tables as S


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events")


def _pick(values: list, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _list(values: list) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


# --- benchmark files -------------------------------------------------------------------------------

WIDTHS, FPS = ["1920", "64", "0", "x", " 17", "14", "+32"], ["", "25", "-1", "60"]


@query(f"""with m as (select p_partkey as row, case when p_partkey % 10 = 0 then '' else 'Clip ' || (p_partkey % 150) || '/' || p_size end as clip, case when p_partkey % 20 = 0 then '' else 'in/' || p_partkey || '.yuv' end as input,
 trim(({_list(WIDTHS)})[p_partkey % 7 + 1]) as w, ({_list(FPS)})[p_partkey % 4 + 1] as f from part),
n as (select row, case when clip <> '' then clip when input <> '' then row || '.yuv' else 'clip' || row end as clip, case when regexp_matches(w, '^[+]?[0-9]+$') and cast(replace(w, '+', '') as int) > 0 then cast(replace(w, '+', '') as int) end as width,
 case when f = '' then 30 when f = '-1' then null else cast(f as int) end as fps, f <> '' as fps_given from m),
d as (select *, regexp_replace(clip, '[^A-Za-z0-9._-]', '_', 'g') as folder, min(row) over (partition by clip) as first from n)
select row, clip, folder, width, fps, fps_given, case when width is null then 'width is not a positive integer' when fps is null then 'fps is not a positive integer' when width < 16 or width % 2 <> 0 then 'frame size is not even and at least 16'
 when first < row then 'clip name is repeated' when min(row) over (partition by lower(folder)) < row then 'folder name collides' end as error from d""")
def clip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with sound and faulty fields, aliases and repeated names."""
    k = F.col("p_partkey")
    rows = S.table(spark, sf_dir, "part").select(
        k.alias("row"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("Clip "), k % 150, F.lit("/"), "p_size")).alias("Name"), F.when(k % 20 == 0, "").otherwise(F.concat(F.lit("in/"), k, F.lit(".yuv"))).alias(" Input"),
        _pick(WIDTHS, k).alias("width"), F.lit("720").alias("HEIGHT"), F.lit("10").alias("frames"), _pick(FPS, k).alias("fps"), F.lit("Talk").alias("Content_Category"))
    return H.clips(rows, "row").select("row", "clip", "folder", "width", "fps", "fps_given", "error")


LOG = "'n:' || (i + 1) || ' mse:1 psnr_avg:' || case when l_orderkey % 9 = 0 then 'INF' else cast(l_quantity as int) || '.25' end"


@query(f"""with v as (select l_orderkey, l_linenumber, case when l_orderkey % 7 = 0 then greatest(l_linenumber - 2, 0) when l_orderkey % 11 = 0 then l_linenumber else l_linenumber - 1 end as i, l_orderkey % 9 = 0 as infinite, cast(l_quantity as int) + 0.25 as value from lineitem),
g as (select l_orderkey, count(*) as n, count(distinct i) as different, max(i) as high, sum(case when infinite then 0 else value end) as total, bool_or(infinite) as infinite from v group by 1)
select l_orderkey, n, case when l_orderkey % 13 = 0 then 'count' when high >= n then 'range' when different <> n then 'repeated' end as error, cast(total as double) as total, infinite from g""")
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a metric log per frame, and whether each log has every frame once."""
    number = F.when(F.col("l_orderkey") % 7 == 0, F.greatest(F.col("l_linenumber") - 2, F.lit(0))).when(F.col("l_orderkey") % 11 == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") - 1)
    value = F.when(F.col("l_orderkey") % 9 == 0, "INF").otherwise(F.concat(F.col("l_quantity").cast("int"), F.lit(".25")))
    line = F.concat(F.lit("n:"), number + 1, F.lit(" mse:1 psnr_avg:"), value)
    rows = S.table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array(line, F.lit("[info] summary"))).alias("line"))
    values = H.frame_values(rows, "line", r"psnr_avg:([0-9.]+|[iI][nN][fF])")
    sums = values.groupBy("l_orderkey").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.bool_or("infinite").alias("infinite"))
    expected = F.when(F.col("l_orderkey") % 13 == 0, F.col("n") + 1).otherwise(F.col("n"))
    return H.contiguous(values, ["l_orderkey"], expected).join(sums, "l_orderkey")


@query("""select c_custkey, case when c_custkey % 5 = 1 then 'frame count' when c_custkey % 5 = 2 then 'no mean' when c_custkey % 5 = 3 then 'no report' end as error, case when c_custkey % 5 in (0, 4) then c_acctbal end as mean from customer""")
def vmaf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled means of metric reports, of which some lack frames, the mean, or are none."""
    k = F.col("c_custkey")
    frames = F.transform(F.sequence(F.lit(1), F.when(k % 5 == 1, 3).otherwise(2)), lambda i: F.struct(i.alias("frameNum")))
    good = F.to_json(F.struct(frames.alias("frames"), F.create_map(F.when(k % 5 == 2, "psnr").otherwise("vmaf"), F.create_map(F.lit("mean"), "c_acctbal")).alias("pooled_metrics")))
    found = H.pooled_mean(F.when(k % 5 == 3, F.lit("no json")).otherwise(good), F.lit(2))
    return S.table(spark, sf_dir, "customer").select("c_custkey", found["error"].alias("error"), found["mean"].alias("mean"))


@query("select 'Benchmark' || event_type || '/n=' || (event_id % 3) as name, count(*) as samples, string_agg(distinct cast(event_id % 4 + 1 as varchar), ',' order by cast(event_id % 4 + 1 as varchar)) as cpus, sum(event_id) as ns, sum(event_id % 50) as bytes from events where event_id % 10 <> 0 group by 1")
def benchmark_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a benchmark log, with units, and their samples and processors per name."""
    i = F.col("event_id")
    line = F.when(i % 10 == 0, "ok  pkg 1.2s").otherwise(F.concat(F.lit("Benchmark"), "event_type", F.lit("/n="), i % 3, F.lit("-"), i % 4 + 1, F.lit("\t100\t"), i, F.lit(" ns/op\t"), i % 50, F.lit(" B/op")))
    lines = _events(spark, sf_dir).select(line.alias("line"))
    at = lambda unit: F.sum(F.filter("measures", lambda x: x["unit"] == unit)[0]["value"]).cast("long")
    sums = H.benchmark_lines(lines, "line").groupBy("name").agg(at("ns/op").alias("ns"), at("B/op").alias("bytes"))
    return H.benchmark_rows(lines, "line").withColumn("cpus", F.array_join(F.transform("cpus", lambda x: x.cast("string")), ",")).join(sums, "name")


@query("""select p_partkey, case when p_partkey % 9 = 0 then 0 else cast(p_size * 1000 * 8 * 30 // (p_partkey % 9) as bigint) end as bps, case when p_size % 4 > 0 then round((p_partkey % 9) / (p_size % 4), 2) end as fps, case when p_size % 4 > 0 then round((p_retailprice + 1) / (p_size % 4), 6) end as parallelism from part""")
def actual_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 9, F.col("p_size") % 4
    return S.table(spark, sf_dir, "part").select("p_partkey", M.actual_bps(F.col("p_size") * 1000, k, F.lit(30)).alias("bps"), M.encode_fps(k, n).alias("fps"), F.round(M.observed_parallelism(n, F.col("p_retailprice"), F.lit(1)), 6).alias("parallelism"))


@query("""select p_partkey, p_name || ',' || p_size || ',"a,b",' || p_type as line from part""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as comma-separated lines; the filled columns are read back from them."""
    row = {"clip": F.col("p_name"), "width": F.col("p_size"), "encoder": F.lit("a,b"), "status": F.col("p_type")}
    rows = S.table(spark, sf_dir, "part").select("p_partkey", H.result_line(row).alias("l"))
    back = F.from_csv("l", ", ".join(f"{c} string" for c in H.RESULT))
    return rows.select("p_partkey", back.alias("b")).select("p_partkey", F.concat(F.col("b.clip"), F.lit(","), F.col("b.width"), F.lit(',"'), F.col("b.encoder"), F.lit('",'), F.col("b.status")).alias("line"))


@query("select label, place, total from (select label, i - 1 as place, cast(sum(cast(round(embedding[i] * 1000) as bigint)) as bigint) as total from embeddings, range(1, 65) r(i) group by 1, 2)")
def stat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of arrays of counters, place by place."""
    rows = S.table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("long")).alias("c"))
    return Q.accumulated(rows, ["label"], "c").select("label", F.col("place").cast("long").alias("place"), "total")


@query("""select n_name, 'clips' as kind, to_json({'n_name': n_name, 'clips': list({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment} order by c_custkey)})::varchar as document from customer join nation on c_nationkey = n_nationkey group by n_name""")
def metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "customer").join(F.broadcast(S.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return H.metadata_json(rows, ["n_name"], ["c_custkey", "c_mktsegment"]).withColumn("kind", F.lit("clips"))


# --- modes and scalars -----------------------------------------------------------------------------

MODES = ["L1T1", "L1T2", "L1T3", "L1T1h", "L1T2_KEY", "L2T1", "L2T1h", "L2T1_KEY", "L2T1_KEY_SHIFT", "L2T2_KEY_SHIFT", "L3T3", "L3T3_KEY", "L3T3h", "L3T4", "L4T1", "S2T1", "S2T3h", "S3T3", "S3T3_KEY", "S1T1", "l3t3", "", "L3T2_KEY_SHIFT"]
KNOWN = {"L1T1": (1, 1, None), "L1T2": (1, 2, 0), "L1T3": (1, 3, 1), "L2T1": (2, 1, 2), "L2T1h": (2, 1, 8), "L2T1_KEY": (2, 1, None), "L2T2_KEY_SHIFT": (2, 2, 25), "L3T3": (3, 3, 17), "L3T3_KEY": (3, 3, 24), "L3T3h": (3, 3, None), "S2T1": (2, 1, 5), "S2T3h": (2, 3, 13), "S3T3": (3, 3, 20), "L3T2_KEY_SHIFT": (3, 2, 27)}
_KNOWN = ", ".join(f"('{k}', {s}, {t}, {'null' if n is None else n})" for k, (s, t, n) in KNOWN.items())


@query(f"""with m as (select event_id, ({_list(MODES)})[event_id % {len(MODES)} + 1] as mode from events), k(mode, spatial, temporal, number) as (values {_KNOWN})
select event_id, spatial, temporal, case when k.mode is not null then k.mode like '%KEY%' end as key, number, k.mode is not null as ok from m left join k using (mode)""")
def scalability_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.scalability_mode(F.col("mode"))
    return _events(spark, sf_dir).select("event_id", _pick(MODES, F.col("event_id")).alias("mode")).select("event_id", *[found[k].alias(k) for k in ("spatial", "temporal", "key", "number", "ok")])


@query(f"""with r as (select event_id, event_id % 40 * 8 as w, event_id % 24 * 8 as h, ({_list([1, 2, 3, 4, 8, 5])})[event_id % 6 + 1] as f, event_id % 2 = 0 as up from events),
t as (select event_id, w, h, case when up then w * f else w // f end as tw, case when up then h * f else h // f end as th from r),
s(i, num, den) as (values {', '.join(f'({i}, {n}, {d})' for i, (n, d) in enumerate(M.SCALINGS))}),
m as (select event_id, arg_min(num || '/' || den, i) as step from t, s where w > 0 and h > 0 and tw > 0 and th > 0 and ((w * num // den = tw and h * num // den = th) or (tw * den // num = w and th * den // num = h)) group by event_id)
select event_id, step from t left join m using (event_id)""")
def resolution_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    w, h, f = i % 40 * 8, i % 24 * 8, _pick([1, 2, 3, 4, 8, 5], i)
    to = lambda x: F.when(i % 2 == 0, x * f).otherwise(F.floor(x / f))
    step = M.resolution_scaling(w, h, to(w), to(h))
    return _events(spark, sf_dir).select("event_id", F.concat(step["num"], F.lit("/"), step["den"]).alias("step"))


@query("""select event_id, case when a > 0 then cast(a * 90000 // gcd(a * 90000, (event_id % 60 + 1) * 1001) as bigint) end as num, case when a > 0 then cast((event_id % 60 + 1) * 1001 // gcd(a * 90000, (event_id % 60 + 1) * 1001) as bigint) end as den from (select event_id, event_id % 9 as a from events)""")
def frame_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame durations as reduced fractions; a rate without a denominator has none."""
    i = F.col("event_id")
    d = M.frame_duration(i % 60 + 1, i % 9, F.lit(1001), F.lit(90000))
    return _events(spark, sf_dir).select("event_id", d["num"].alias("num"), d["den"].alias("den"))


@query("""with p as (select event_id, [event_id * 37 % 4096, event_id * 91 % 4096, event_id * 7 % 4096] as p, event_id % 4 as t, event_id % 3 as s from events)
select event_id, case when p[1] = 0 or ((p[1] >> cast(t as int)) & 1 = 1 and (p[1] >> cast(8 + s as int)) & 1 = 1) then 0 when p[2] = 0 or ((p[2] >> cast(t as int)) & 1 = 1 and (p[2] >> cast(8 + s as int)) & 1 = 1) then 1
 when p[3] = 0 or ((p[3] >> cast(t as int)) & 1 = 1 and (p[3] >> cast(8 + s as int)) & 1 = 1) then 2 end as point from p""")
def operating_point_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", M.select_operating_point(F.array(i * 37 % 4096, i * 91 % 4096, i * 7 % 4096), i % 4, i % 3).alias("point"))


@query("select event_id, cast(event_id * 2654435761 % 4294967295 as bigint) as value, cast((event_id * 2654435761 % 4294967296 >> 13) & 2047 as bigint) as field from events")
def bit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable-length integers coded and read, and a field of eleven bits cut out of a word."""
    i = F.col("event_id")
    word = F.unhex(F.lpad(F.hex(i * 2654435761 % 4294967296), 8, "0"))
    return _events(spark, sf_dir).select("event_id", M.uvlc(M.uvlc_bytes(i * 2654435761 % 4294967295)).alias("value"), M.read_bits(word, F.lit(8), F.lit(11)).alias("field"))


NAMES, PATTERNS = [" Own ", "libaom", "SVT", "svtav1encapp", "x264", ""], ["^BenchmarkA_1$", "^Benchmark$", "BenchmarkA$", "^BenchmarkA/b$", "^BenchmarkZz"]


@query(f"""select event_id, ({_list(['own', 'aomenc', 'svt-av1', 'svt-av1', None, None])})[event_id % 6 + 1] as encoder, event_id % 5 = 0 as exact, case when event_id % 3 < 2 then md5(event_type) || md5(event_type) end as digest,
(event_id * 3) & 5 <> 0 and event_id & 2 <> 0 as chosen, event_id % 4 < 2 as stream_id, sha256(event_type) as file_digest, case when event_id % 4 < 3 then cast(event_id % 4 as int) end as profile from events""")
def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder names, benchmark patterns, digests, masks of vectors, stream ids and profiles."""
    i, d = F.col("event_id"), F.md5(F.col("event_type").cast("binary"))
    return _events(spark, sf_dir).select(
        "event_id", M.encoder_name(_pick(NAMES, i), {"own": "own"}).alias("encoder"), M.is_exact_benchmark(_pick(PATTERNS, i)).alias("exact"), M.canonical_sha256(F.when(i % 3 == 0, F.upper(F.concat(d, d))).when(i % 3 == 1, F.concat(F.lit(" "), d, d)).otherwise(d)).alias("digest"),
        M.selected(i * 3, i, 5, 2).alias("chosen"), M.is_stream_id(_pick(["a1", "Zz9", "a-1", ""], i)).alias("stream_id"), F.sha2(F.col("event_type").cast("binary"), 256).alias("file_digest"), M.profile(_pick(["0", "1", "2", "3"], i)).alias("profile"))


# --- buffers, repair, references, layers -----------------------------------------------------------

@query("with recursive " + S.PACKETS + """, n as (select ssrc, ext_seq, size, row_number() over (partition by ssrc order by ext_seq) as i from pk),
b as (select ssrc, i, ext_seq, least(greatest(2000 - size, -48000), 6000) as level from n where i = 1
 union all select n.ssrc, n.i, n.ext_seq, least(greatest(b.level + 2000 - n.size, -48000), 6000) from b join n on n.ssrc = b.ssrc and n.i = b.i + 1),
q as (select *, 100 + ext_seq % 80 as q from b)
select ssrc, ext_seq, level, cast(least(greatest(trunc(-level * 4 / 2000), -12), 12) as bigint) as step,
 cast(case when level >= 0 then least(greatest(q - 12, 20), 20 + 200 * 2 // 3) else greatest(q - 12 * (3 * 48000 + greatest(48000 + level, 0)) // (4 * 48000), 20) end as bigint) as key_q from q""")
def rate_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate controller's buffer, the step it moves the quantiser by, and the quantiser of a key frame."""
    rows, level = R.rate_levels(S.packets(spark, sf_dir), 2000, 3), F.col("level")
    return rows.select("ssrc", "ext_seq", "level", M.step_of(level, F.lit(2000)).alias("step"), M.key_frame_q(100 + F.col("ext_seq") % 80, F.lit(2000), level, F.lit(20), F.lit(220)).alias("key_q"))


@query("with " + S.PACKETS + """, q as (select ssrc, seq, seq + seq * 7 % 120 as at from lost), c as (select q.ssrc, q.seq, q.at, max(ext_seq) as held from q join pk on pk.ssrc = q.ssrc and pk.ext_seq <= q.at and pk.ext_seq % 64 = q.seq % 64 group by 1, 2, 3)
select c.ssrc, c.seq, c.at, size, row_number() over (partition by c.ssrc order by c.at, c.seq) as rtx_seq from c join pk on pk.ssrc = c.ssrc and pk.ext_seq = c.seq where held = c.seq""")
def rtx_as_of_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost packets that the cache still holds when they are asked for."""
    asked = S.lost(spark, sf_dir).withColumn("at", F.col("seq") + F.col("seq") * 7 % 120)
    return R.repaired_at(asked, S.packets(spark, sf_dir)).select("ssrc", "seq", "at", "size", "rtx_seq")


@query(f"""with {S.UNITS}, p as (select user_id, event_id, event_id % 8 as base, event_type = 'purchase' as refreshes from ob), a as (select user_id, event_id, cast(k as int) as place, (base + k) % 8 as slot from p, range(7) r(k)),
s as (select user_id, event_id as stored, base as slot from p where refreshes)
select a.user_id, a.event_id, place, slot, max(stored) as reference from a left join s using (user_id, slot) where stored is null or stored < a.event_id or true group by 1, 2, 3, 4 having max(stored) is null or true""".replace("max(stored) as reference", "max(case when stored < a.event_id then stored end) as reference").replace(" where stored is null or stored < a.event_id or true", "").replace(" having max(stored) is null or true", ""))
def reference_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven references of each picture, as of the pictures before it."""
    i = F.col("event_id")
    pictures = S.units(spark, sf_dir).select("user_id", "event_id", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: (i + k) % 8).alias("slots"), F.when(F.col("event_type") == "purchase", F.array(i % 8)).otherwise(F.array().cast("array<bigint>")).alias("refreshes"))
    return R.reference_frames(pictures, "user_id", "event_id", "slots", "refreshes")


@query(f"""with {S.UNITS}, l as (select *, last_value(case when type in (2, 3, 6) then type end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as last from ob)
select event_id, case type when 1 then 'sequence' when 2 then 'delimiter' when 3 then 'frame header' when 4 then 'tiles' when 5 then 'metadata' when 6 then 'frame' when 7 then case when last = 3 then 'ignored' else 'frame header' end when 8 then 'tile list' when 15 then 'padding' else 'reserved' end as event,
 type in (3, 6) and t > 0 as outputs, type in (3, 6) and t = 0 as drops from l""")
def unit_event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each unit does, and which events give or drop a frame (here by temporal layer)."""
    rows = R.unit_events(S.units(spark, sf_dir), "user_id", "event_id")
    frame = F.col("type").isin(3, 6)
    return rows.select("event_id", "event", (frame & (F.col("t") > 0)).alias("outputs"), (frame & (F.col("t") == 0)).alias("drops"))


@query("select event_type, cast(floor(event_id / 50) as bigint) as g, max(event_id) filter (event_id % 3 = 1) as pinned, max(event_id) as shown, count(*) as completed from events group by 1, 2")
def spatial_layer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last output of a pinned layer, and the last of all, of groups of outputs."""
    rows = _events(spark, sf_dir).select("event_type", F.floor(F.col("event_id") / 50).alias("g"), "event_id", (F.col("event_id") % 3).alias("s"))
    one, every = R.layer_outputs(rows, ["event_type", "g"], "event_id", "s", 1), R.layer_outputs(rows, ["event_type", "g"], "event_id", "s")
    return one.select("event_type", "g", F.col("event_id").alias("pinned")).join(every.select("event_type", "g", F.col("event_id").alias("shown"), "completed"), ["event_type", "g"])


@query("""select event_id, array_to_string(case when event_id % 4 = 0 then [target // 6, target * 2 // 6, target - target // 6 - target * 2 // 6] else [target * a // (a + b + c), target * b // (a + b + c), target - target * a // (a + b + c) - target * b // (a + b + c)] end, ',') as layers
from (select event_id, event_id * 1000 + 77 as target, event_id % 100 + 1 as a, event_id % 70 as b, event_id % 30 as c from events)""")
def layer_bitrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimate over layers in proportion to their targets, or by weights where they have none."""
    i = F.col("event_id")
    layers = F.when(i % 4 == 0, F.array(*[F.lit(0).cast("long")] * 3)).otherwise(F.array(i % 100 + 1, i % 70, i % 30))
    return _events(spark, sf_dir).select("event_id", F.array_join(F.transform(M.split_bitrate(i * 1000 + 77, layers), lambda x: x.cast("string")), ",").alias("layers"))


# --- summaries -------------------------------------------------------------------------------------

@query("""with s as (select o_orderpriority as clip, o_orderstatus as encoder, case when o_custkey % 2 = 0 then 'psnr' else 'vmaf' end as metric, round(avg(o_totalprice), 4) as rate from orders where o_custkey % 40 > 30 and o_orderkey % 3 = 0 and o_orderstatus <> 'P' group by 1, 2, 3),
g as (select * from (select distinct o_orderpriority as clip from orders), (values ('F'), ('O'), ('P')) e(encoder), (values ('psnr'), ('vmaf')) m(metric))
select clip, encoder, metric, rate, case when rate is null then 'missing clip summary' else 'ok' end as status from g left join s using (clip, encoder, metric)""")
def summary_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip, encoder and metric with its summary, or an error row."""
    orders = S.table(spark, sf_dir, "orders")
    found = orders.filter("o_custkey % 40 > 30 and o_orderkey % 3 = 0 and o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("clip"), F.col("o_orderstatus").alias("encoder"), F.when(F.col("o_custkey") % 2 == 0, "psnr").otherwise("vmaf").alias("metric")).agg(F.round(F.avg("o_totalprice"), 4).alias("rate")).withColumn("status", F.lit("ok"))
    return Q.summary_grid(found, orders.select(F.col("o_orderpriority").alias("clip")).distinct(), ["F", "O", "P"], ["psnr", "vmaf"])


@query("select l_linenumber as bitrate, arg_max(l_extendedprice / l_quantity, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber) as parallelism from lineitem where l_returnflag = 'A' and l_linestatus = 'F' group by 1")
def parallelism_by_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = S.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("bitrate"), F.when(F.col("l_returnflag") == "A", "own").otherwise("aomenc").alias("encoder"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("error").alias("status"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("n"), "l_extendedprice", "l_quantity")
    return Q.parallelism_by_bitrate(jobs, "own", M.observed_parallelism(F.col("l_quantity"), F.col("l_extendedprice"), F.lit(0)), "n")


@query("""with r as (select p_brand, p_retailprice, row_number() over (partition by p_brand order by p_retailprice) - 1 as i, count(*) over (partition by p_brand) as n from part), m as (select p_brand, max(p_retailprice) filter (i = n // 2) as median from r group by 1)
select p_brand, median, round(median / (select median from m where p_brand = 'Brand#11'), 9) as ratio from m""")
def decoder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians per decoder (here per brand), and their ratios to one of them."""
    return Q.decoder_summary(S.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice", "Brand#11").withColumn("ratio", F.round("ratio", 9))


@query("select s_suppkey, cast(p as int) as pass, cast(row_number() over (partition by p order by md5('7:' || p || ':' || s_suppkey), s_suppkey) as int) as place from supplier, range(3) r(p)")
def shuffled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs shuffled within each pass."""
    return Q.run_order(S.table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], 3, 7)


@query("select p_size as path, count(*) as n, string_agg(distinct p_brand, ',' order by p_brand) as labels from part group by 1 having count(*) > 1")
def shared_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.shared_paths(S.table(spark, sf_dir, "part").select(F.col("p_size").alias("path"), "p_brand"), "path", "p_brand")


# --- samples and pictures --------------------------------------------------------------------------

def _bl(rest: str) -> str:
    return f"with {S.BLOCKS}{rest}"


def _listed(column) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(_bl(" select vec_id, array_to_string(list_transform(range(64), lambda i: case when i % 8 between 2 and 4 and i // 8 between 1 and 6 then 17 else q[i + 1] end), ',') as samples from bl"))
def block_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir).select("vec_id", _listed(B.filled("q", 2, 1, 3, 6, 17)).alias("samples"))


@query(_bl(" select vec_id, array_to_string(list_transform(range(64), lambda i: case when i % 8 between 1 and 4 and i // 8 between 2 and 5 then b[i + 1 - 2 * 8 + 3] else a[i + 1] end), ',') as samples from pr"))
def block_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_pairs(spark, sf_dir).select("vec_id", _listed(B.copied("a", "b", (1, 2), (4, 0), 4, 4)).alias("samples"))


@query(_bl(""" select vec_id, array_to_string(list_transform(list_zip(a, b), lambda t: (t[1] * 11 + t[2] * 5 + 8) >> 4), ',') as by_distance,
array_to_string(list_transform(list_zip(a, b), lambda t: (t[1] * least(38 + abs(t[1] - t[2]) // 16, 64) + t[2] * (64 - least(38 + abs(t[1] - t[2]) // 16, 64)) + 32) >> 6), ',') as by_difference from pr"""))
def block_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_pairs(spark, sf_dir).select("vec_id", _listed(B.distance_blended("a", "b", 11)).alias("by_distance"), _listed(B.difference_blended("a", "b")).alias("by_difference"))


_HALF = "list_transform(range(32), lambda i: (q[(i // 8) * 16 + i % 8 + 1] + q[(i // 8) * 16 + i % 8 + 9] + 1) >> 1)"
_P1 = "list_transform(range(16), lambda i: (q[(i // 4) * 16 + (i % 4) * 2 + 1] + q[(i // 4) * 16 + (i % 4) * 2 + 2] + q[(i // 4) * 16 + (i % 4) * 2 + 9] + q[(i // 4) * 16 + (i % 4) * 2 + 10] + 2) >> 2)"
_P2 = "list_transform(range(4), lambda i: (h[(i // 2) * 8 + (i % 2) * 2 + 1] + h[(i // 2) * 8 + (i % 2) * 2 + 2] + h[(i // 2) * 8 + (i % 2) * 2 + 5] + h[(i // 2) * 8 + (i % 2) * 2 + 6] + 2) >> 2)"


@query(_bl(f", l as (select vec_id, q, {_P1} as h from bl), k as (select *, {_P2} as g from l) select vec_id, array_to_string({_HALF}, ',') as half_height, array_to_string(g, ',') as quarter, (g[1] + g[2] + g[3] + g[4] + 2) >> 2 as top from k"))
def chroma_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows averaged two by two, and the levels of a pyramid."""
    levels = B.pyramid("q")
    return S.blocks(spark, sf_dir).select("vec_id", _listed(B.half_height("q")).alias("half_height"), _listed(levels[2]).alias("quarter"), F.get(levels[3], F.lit(0)).alias("top"))


@query(_bl(""", s as (select vec_id, (y // 4) * 2 + x // 4 as k, sum(q[y * 8 + x + 1]) as s, sum(q[y * 8 + x + 1] * q[y * 8 + x + 1]) as e from bl, range(8) a(x), range(8) b(y) group by 1, 2)
select vec_id, string_agg(cast(cast(e - s * s // 16 as bigint) as varchar), ',' order by k) as variances from s group by vec_id"""))
def variance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir).select("vec_id", _listed(B.variance_map("q")).alias("variances"))


# Sixteen vectors are a picture of 32x32 samples; two of three of its blocks are cut to four values.
_CUT = "case when vec_id % 3 = 0 then x else x // 64 * 64 end"


@query(_bl(f""", b as (select vec_id // 16 as picture, vec_id % 4 as bx, vec_id // 4 % 4 as bz, list_transform(q, lambda x: {_CUT}) as q from bl where vec_id // 16 < (select count(*) // 16 from bl)),
px as (select picture, cast(bx * 8 + (i - 1) % 8 as int) as x, cast(bz * 8 + (i - 1) // 8 as int) as y, q[i] as v from b, range(1, 65) r(i)),
w as (select b.picture, bx, bz, sum(v - 128) as s, sum((v - 128) * (v - 128)) as e from b, range(16) i(i), range(16) j(j), px where px.picture = b.picture and px.x = least(bx * 8 + i, 31) and px.y = least(bz * 8 + j, 31) group by 1, 2, 3),
n8 as (select picture, x // 8 as bx, y // 8 as bz, count(distinct v) as n from px group by 1, 2, 3), n16 as (select picture, x // 16 * 2 as bx, y // 16 * 2 as bz, count(distinct v) as n from px group by 1, 2, 3),
c as (select w.picture, n16.n between 2 and 4 as few16, n8.n between 2 and 4 as few8, cast(e - s * s // 256 as bigint) as var from w join n8 using (picture, bx, bz) left join n16 using (picture, bx, bz)),
k as (select picture, count(*) filter (few16) as c16, count(*) filter (few16 and (var + 128) >> 8 > 0) as v16, count(*) filter (few8) as c8, count(*) filter (few8 and (var + 32) >> 6 > 16) as v8 from c group by 1)
select *, c16 * 2560 > 1024 as class0, c16 * 2560 > 1024 and v16 * 3072 > 1024 as class1, (c16 * 2560 > 1024 and v16 * 3072 > 1024) or (c16 * 2560 > 4096 and v16 * 7680 > 1024) as class2,
 (c16 * 2560 > 1024 and v16 * 3072 > 1024) or (c16 * 2048 > 1024 and v16 * 12800 > 1024) as class3, c8 * 1152 > 1024 and v8 * 1280 > 1024 as class4 from k"""))
def screen_content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of blocks of few values per picture, and its classes."""
    i, rows = F.col("vec_id"), S.blocks(spark, sf_dir)
    pictures = rows.groupBy(F.floor(i / 16).alias("picture")).agg(F.count(F.lit(1)).alias("n")).filter("n = 16").select("picture")
    cut = F.transform("q", lambda x: F.when(i % 3 == 0, x).otherwise((F.floor(x / 64) * 64).cast("int")))
    blocks = rows.select(F.floor(i / 16).alias("picture"), (i % 4).alias("bx"), (F.floor(i / 4) % 4).alias("by"), cut.alias("q")).join(pictures, "picture")
    return B.screen_classes(blocks, "picture", 32, 32)


@query(_bl(" select vec_id // 4 as file, cast(vec_id % 4 as int) as frame, list_sum(q) as y, list_sum(q[1:16]) as u, list_sum(q[17:32]) as v, list_sum(list_transform(range(0, 32), lambda i: q[2 * i + 1] + 256 * q[2 * i + 2])) as wide from bl where vec_id // 4 < (select count(*) // 4 from bl)"))
def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pictures a raw file, written as planes, read as frames and samples (and as samples of two bytes)."""
    planes = F.concat(H.plane_bytes(F.col("q")), H.plane_bytes(F.slice("q", 1, 16)), H.plane_bytes(F.slice("q", 17, 16)))
    files = S.blocks(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).alias("file")).agg(F.array_sort(F.collect_list(F.struct("vec_id", planes.alias("b")))).alias("f")).filter(F.size("f") == 4)
    frames = H.i420_frames(files.select("file", K.joined_bytes(F.transform("f", lambda x: x["b"])).alias("content")), 8, 8)
    summed = lambda c, n=1: F.aggregate(H.samples(F.col(c), n), F.lit(0).cast("long"), lambda s, x: s + x)
    frames = frames.select("file", "frame", F.col("y").alias("luma"), F.col("u").alias("cb"), F.col("v").alias("cr"))
    return frames.select("file", "frame", summed("luma").alias("y"), summed("cb").alias("u"), summed("cr").alias("v"), summed("luma", 2).alias("wide"))


_HEX = "list_aggregate(list_transform({}, lambda x: format('{{:02x}}', x)), 'string_agg', '')"


@query(_bl(f""" select vec_id // 4 as file, cast(vec_id % 4 as int) as frame, md5(unhex({_HEX.format('q')} || case when vec_id % 3 = 0 then repeat('80', 32) else {_HEX.format('q[1:16]')} || {_HEX.format('q[17:32]')} end)) as digest from bl where vec_id // 4 < (select count(*) // 4 from bl)"""))
def frame_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the planes of the pictures in raw files, one in three without chroma."""
    planes = F.concat(H.plane_bytes(F.col("q")), H.plane_bytes(F.slice("q", 1, 16)), H.plane_bytes(F.slice("q", 17, 16)))
    files = S.blocks(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).alias("file")).agg(F.array_sort(F.collect_list(F.struct("vec_id", planes.alias("b")))).alias("f")).filter(F.size("f") == 4)
    frames = H.i420_frames(files.select("file", K.joined_bytes(F.transform("f", lambda x: x["b"])).alias("content")), 8, 8)
    grey = (F.col("file") * 4 + F.col("frame")) % 3 == 0
    return frames.select("file", "frame", H.frame_md5(F.col("y"), F.when(~grey, F.col("u")), F.when(~grey, F.col("v")), 16).alias("digest"))


@query("select doc_id // 3 as file, cast(row_number() over (partition by doc_id // 3 order by doc_id) - 1 as int) as idx, md5(text) as digest from documents where text <> ''")
def length_prefixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").filter("text <> ''").select(F.floor(F.col("doc_id") / 3).alias("file"), "doc_id", H.record_bytes(F.encode("text", "utf-8")).alias("b"))
    files = docs.groupBy("file").agg(K.joined_bytes(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "b"))), lambda x: x["b"])).alias("content"))
    return H.length_prefixed(files).select("file", "idx", F.md5("payload").alias("digest"))


@query("select doc_id // 8 as file, cast(i as int) as idx, md5(text) as digest from (select doc_id, text, row_number() over (partition by doc_id // 8 order by doc_id) - 1 as i from documents) where i % 3 = 1")
def ivf_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some frames of files, cut out by the places in an index."""
    docs = S.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 8).alias("file"), F.col("doc_id").alias("idx"), F.col("doc_id").alias("pts"), F.encode("text", "utf-8").alias("payload"))
    files = K.ivf_file(docs, ["file"], 64, 64, 90000, 1)
    wanted = files.select("file", F.explode(F.array(F.lit(1), F.lit(4), F.lit(7))).alias("idx"))
    return H.ivf_at(files, wanted, ["file"]).select("file", "idx", F.md5("payload").alias("digest"))

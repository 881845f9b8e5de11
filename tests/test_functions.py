"""Scalar functions on literal cases and edge values."""

from pyspark.sql import functions as F

from tributary.functions import columns as C
from tributary.functions import text as T
from tributary.operators import blocks as B
from tributary.operators import quality as Q


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_modular_order(spark):
    assert one(spark, C.seq_distance(F.col("a"), F.col("b")), a=2, b=65534) == 4
    assert one(spark, C.seq_distance(F.col("a"), F.col("b")), a=65534, b=2) == -4
    assert one(spark, C.order_hint_distance(F.col("a"), F.col("b"), 4), a=1, b=15) == 2


def test_temporal_ids(spark):
    df = spark.range(0, 9).select(C.temporal_id(3, F.col("id")))
    assert [r[0] for r in df.collect()] == [None, 2, 1, 2, 0, 2, 1, 2, 0]


def test_scale_and_numbers(spark):
    assert one(spark, C.scale_factor_q14(F.col("a"), F.col("b")), a=64, b=32) == 32768
    assert one(spark, C.scale_factor_q14(F.col("a"), F.col("b")), a=65, b=32) is None
    assert one(spark, C.finite(F.col("t")), t="1.5") == 1.5
    assert one(spark, C.finite(F.col("t")), t="inf") is None
    assert one(spark, C.finite(F.col("t")), t="x") is None


def test_session_description(spark):
    line = spark.createDataFrame([("a=rtpmap:98 AV1/90000", "a=simulcast:send 1,2;3 recv 4", "Benchmark_A/x-8   100  12.5 ns/op"), ("a=rtpmap:x", "", "ok")], "r string, s string, b string")
    m, b = T.rtpmap(F.col("r")), T.benchmark_row(F.col("b"))
    got = line.select(m["payload_type"], m["codec"], m["clock"], T.simulcast(F.col("s")), b["cpus"], b["ns"]).collect()
    assert tuple(got[0]) == (98, "AV1", 90000, [["1", "2"], ["3"]], 8, 12.5)
    assert tuple(got[1]) == (None,) * 6


def test_allows(spark):
    df = spark.createDataFrame([("profile=1;level-idx=8;tier=0", "profile=0;level-idx=8;tier=0"), ("profile=0;level-idx=8;tier=0", "profile=0;level-idx=8;tier=1")], "a string, b string")
    assert [r[0] for r in df.select(T.allows(T.fmtp(F.col("a")), T.fmtp(F.col("b")))).collect()] == [True, False]


def test_hadamard_of_a_constant(spark):
    df = spark.range(1).select(F.array_repeat(F.lit(3), 64).alias("a"), F.array_repeat(F.lit(1), 64).alias("b"))
    assert df.select(B.satd("a", "b"), B.sse("a", "b"), B.variance("a", "b")).first() == (128, 256, 0)


def test_bd_rate_of_scaled_curves(spark):
    base = [(30.0, 100.0), (35.0, 200.0), (40.0, 400.0), (45.0, 800.0)]
    rows = [("c", "A", i, r, m) for i, (m, r) in enumerate(base)]
    for name, k in (("same", 1.0), ("double", 2.0), ("half", 0.5)):
        rows += [("c", name, i, r * k, m) for i, (m, r) in enumerate(base)]
    rows += [("c", "short", i, r, m) for i, (m, r) in enumerate(base[:3])] + [("c", "apart", i, r, m + 50) for i, (m, r) in enumerate(base)]
    out = {r.encoder: (r.bd_rate, r.status) for r in Q.bd_rate(spark.createDataFrame(rows, "clip string, encoder string, target int, rate double, metric double"), "A").collect()}
    assert out == {"same": (0.0, "ok"), "double": (100.0, "ok"), "half": (-50.0, "ok"), "short": (None, "too few points"), "apart": (None, "no overlap")}

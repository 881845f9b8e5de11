"""Operators on one key with a thousand times the rows of the others, and on values of any length, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import quality as Q
from tributary.operators import transport as R
from tributary.operators.scans import numbered
from tributary.sources import bench as H
from tributary.sources import containers as K


def packed(seqs):
    out, pid = {}, None
    for x in sorted(set(seqs)):
        if pid is None or x > pid + 16:
            pid = x
            out[pid] = 0
        else:
            out[pid] |= 1 << (x - pid - 1)
    return out


def test_losses_of_any_density(spark, monkeypatch):
    r = random.Random(1)
    streams = {1: range(65530, 65530 + 60_000), 2: range(0, 5000, 2), 3: [x for x in range(20_000) if r.random() < 0.3], 4: [5], 5: [1023, 1024, 1039, 1040, 5000, 2047, 2048, 2063, 2064], 6: range(1000, 1100)}
    rows = [(s, x) for s, seqs in streams.items() for x in seqs] + [(4, 5), (4, None)]
    df = spark.createDataFrame(rows, "ssrc long, seq long")
    for pieces in (256, 3):
        monkeypatch.setattr(R, "PIECES", pieces)
        got = {}
        for p in R.packed_nacks(df).collect():
            got.setdefault(p.ssrc, {})[p.pid] = p.mask
        assert got == {s: packed(seqs) for s, seqs in streams.items()}
    assert R.packed_nacks(df.limit(0)).collect() == []
    assert sorted(map(tuple, R.expanded_nacks(R.packed_nacks(df)).collect())) == sorted((s, x) for s, seqs in streams.items() for x in seqs)


def test_ranges_are_written_out_in_blocks(spark):
    df = spark.createDataFrame([(1, 0, 25_000), (2, 7, 7), (3, 5, 4), (4, -3, 20)], "k int, low long, high long")
    got = numbered(df, "low", "high", "x", 10).groupBy("k").agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.count_distinct("x")).collect()
    assert sorted(map(tuple, got)) == [(1, 25_001, 0, 25_000, 25_001), (2, 1, 7, 7, 1), (4, 24, -3, 20, 24)]


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_quartiles_of_a_hot_group(spark, buckets):
    r = random.Random(buckets)
    groups = {"hot": [round(r.choice([5.0, r.gauss(0, 3), 1e6 * r.random()]), 3) for _ in range(20_000)], "same": [2.5] * 50, "one": [1.0], "two": [3.0, 1.0], None: [float(x) for x in range(17)]}
    rows = [(k, v, i) for k, vs in groups.items() for i, v in enumerate(vs)] + [("hot", None, 1), ("null", None, 1)]
    got = {x.k: x for x in Q.order_statistics(spark.createDataFrame(rows, "k string, v double, i int"), ["k"], "v", buckets).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        assert (got[k].low, got[k].q1, got[k].median, got[k].q3, got[k].high) == (vs[0], vs[n // 4], vs[n // 2], vs[n * 3 // 4], vs[-1])


def test_nearest_candidates_without_pairs(spark):
    r = random.Random(3)
    candidates = [(k, i, float(r.randint(-50, 50))) for k in "ab" for i in range(3000 if k == "a" else 3)]
    jobs = [(k, r.randint(-600, 600) / 10) for k in "ab" for _ in range(400 if k == "a" else 2)] + [("a", 0.5), ("c", 1.0)]
    got = Q.nearest(spark.createDataFrame(jobs, "k string, goal double"), spark.createDataFrame(candidates, "k string, level int, value double"), ["k"])
    want = []
    for k, goal in jobs:
        best = min(((round(abs(v - goal), 9), v > goal, level) for q, level, v in candidates if q == k), default=None)
        want += [] if best is None else [(k, goal, best[2], best[0])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_benchmark_lines_with_faults(spark):
    lines = ["BenchmarkA-8\t10\t5 ns/op", "BenchmarkB-99999999999\t1\t5 ns/op", "BenchmarkC-0 1 5 ns/op", "BenchmarkD 1 5 ns/op", "BenchmarkE-2 1 x ns/op 7 B/op", "BenchmarkF-1", "", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [(r.name, r.cpus, [tuple(m) for m in r.measures]) for r in H.benchmark_lines(df, "line").collect()] == [("BenchmarkA", 8, [(5.0, "ns/op")]), ("BenchmarkE", 2, [(None, "ns/op"), (7.0, "B/op")]), ("BenchmarkF", 1, [])]
    assert [(r.name, r.samples, r.cpus) for r in H.benchmark_rows(df, "line").orderBy("name").collect()][0] == ("BenchmarkA", 1, [8])


def test_documents_of_many_clips(spark):
    df = spark.range(25).select(F.lit("a").alias("k"), F.col("id").alias("clip"))
    docs = [r.document for r in H.metadata_json(df, ["k"], ["clip"], 10).collect()]
    assert sorted(len(d.split('{"clip"')) - 1 for d in docs) == [5, 10, 10] and len(H.metadata_json(df, ["k"], ["clip"]).collect()) == 1


def test_frames_by_place(spark):
    rows = spark.range(40).select((F.col("id") % 4).alias("file"), (F.col("id")).alias("idx"), F.col("id").alias("pts"), F.encode(F.col("id").cast("string"), "utf-8").alias("payload"))
    files = K.ivf_file(rows, ["file"], 8, 8, 30, 1)
    wanted = spark.createDataFrame([(0, 1), (0, 1), (0, 9), (1, 0), (3, 10)], "file long, idx int")
    assert sorted((r.file, r.idx, bytes(r.payload)) for r in H.ivf_at(files, wanted, ["file"]).collect()) == [(0, 1, b"4"), (0, 9, b"36"), (1, 0, b"1")]


def test_streams_in_segments_of_any_size(spark, duck, monkeypatch):
    """Streams cut into segments of a few units, between temporal units where those are numbered, read as whole ones."""
    from compare import same

    from tributary.plans import payload, registry

    SF = "/root/testdata/sf0.001"
    for limit in (1, 300):
        monkeypatch.setattr(registry, "FILE", limit)
        monkeypatch.setattr(payload, "FILE", limit)
        for name in ("temporal_units", "annexb_temporal_units", "annexb_to_low_overhead", "annexb_roundtrip"):
            same(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name]))


def test_statistics_and_categories(spark, tmp_path):
    H.write_stats(spark.createDataFrame([("a", 5, "ok")], "clip string, tiles int, status string").coalesce(1), str(tmp_path / "s"))
    [row] = spark.read.csv(str(tmp_path / "s"), header=True).collect()
    assert len(row) == 40 and (row.clip, row.tiles, row.status, row.error) == ("a", "5", "ok", None) and row.__fields__ == list(H.STATS)
    rates = spark.createDataFrame([("x", "e", 2.0, "ok"), ("y", "e", 4.0, "ok"), ("z", "e", None, "no anchor"), ("x", "f", 1.0, "ok")], "clip string, encoder string, bd_rate double, status string")
    clips = spark.createDataFrame([("x", "Talk  show"), ("y", " talk show"), ("z", None)], "clip string, category string")
    got = {(r.label, r.encoder): (r["mean"], r.clips, r.failed) for r in Q.bd_rate_categories(rates, clips).collect()}
    assert got == {("overall", "e"): (None, 3, 1), ("overall", "f"): (1.0, 1, 0), ("category:talk show", "e"): (3.0, 2, 0), ("category:talk show", "f"): (1.0, 1, 0)}

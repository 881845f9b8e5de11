"""Live operators against their batch twins, for several cuts into batches."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import transport as R
from tributary.sources import payloads as P
from tributary.sources import tables as S
from tributary.streaming import live

SF = "/root/testdata/sf0.001"


def fragments(spark):
    from pyspark.sql.window import Window

    docs = S.table(spark, SF, "documents").select("source", "doc_id", F.encode(F.substring("text", 1, 4000), "utf-8").alias("data"))
    rows = P.fragmented(docs, "data", 300, F.col("doc_id") % 5 == 0)
    order = Window.partitionBy("source").orderBy("doc_id", "part")
    return rows.select(F.pmod(F.xxhash64("source"), F.lit(1000)).alias("ssrc"), (F.row_number().over(order) - 1).cast("long").alias("ext_seq"), "payload").filter("ext_seq % 13 <> 5")


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_units_equal_the_batch_twin_for_any_cut(spark, tmp_path, batches):
    rows = fragments(spark).withColumn("cut", F.floor(F.col("ext_seq") * batches / 200) % 50)
    want = {(r.ssrc, r.first_seq): (r.last_seq, r.fragments, r.new_sequence, bytes(r.data)) for r in P.reassembled(rows).filter("complete").collect()}
    got = live.played(rows, "cut", str(tmp_path), live.live_units, live.UNITS).collect()
    assert {(r.ssrc, r.first_seq): (r.last_seq, r.fragments, r.new_sequence, bytes(r.data)) for r in got if r.dropped is None} == want
    assert len([r for r in got if r.dropped is None]) == len(want) > 40
    assert {r.dropped for r in got} == {None, "gap"} and all(r.data is None for r in got if r.dropped)


def test_limits_interruptions_and_late_packets(spark, tmp_path):
    part = lambda z, y, data: bytes([(z << 7) | (y << 6) | 0x10]) + data
    rows = [(1, 0, part(0, 1, b"ab"), 0), (1, 1, part(1, 0, b"c"), 1), (1, 1, part(1, 0, b"c"), 2), (1, 2, part(0, 1, b"x" * 50), 2), (1, 3, part(1, 1, b"y" * 60), 3), (1, 4, part(1, 0, b"z"), 3), (1, 5, part(0, 1, b"left"), 3), (1, 6, part(0, 0, b"new"), 4),
            (1, 7, None, 4), (1, 8, b"\x07", 4), (1, 9, part(0, 1, b"q"), 4), (1, 9, part(0, 1, b"late"), 5), (1, 10, part(1, 0, b""), 5), (2, 5, part(1, 0, b"orphan"), 0), (2, 6, part(0, 0, b"ok"), 1)]
    df = spark.createDataFrame([(s, q, None if p is None else bytearray(p), c) for s, q, p, c in rows], "ssrc long, ext_seq long, payload binary, cut int")
    got = live.played(df, "cut", str(tmp_path), lambda s: live.live_units(s, limit=100), live.UNITS)
    assert sorted((r.ssrc, r.first_seq, r.last_seq, r.fragments, r.data and bytes(r.data), r.dropped) for r in got.collect()) == [
        (1, 0, 1, 2, b"abc", None), (1, 2, 3, 2, None, "bytes"), (1, 5, 5, 1, None, "interrupted"), (1, 6, 6, 1, b"new", None), (1, 9, 10, 2, b"q", None), (2, 6, 6, 1, b"ok", None)]


@pytest.mark.parametrize("batches,ttl", [(1, None), (5, None), (5, "1 hour")])
def test_repairs_equal_the_batch_twin_for_any_cut(spark, tmp_path, batches, ttl):
    sent = S.packets(spark, SF).select("ssrc", "ext_seq", "size")
    asked = S.lost(spark, SF).select("ssrc", "seq", (F.col("seq") + F.col("seq") % 90).alias("at"))
    want = R.repaired_at(asked, sent, 64).select("ssrc", "seq", "at", "size", "rtx_seq")
    both = sent.select("ssrc", F.col("ext_seq").alias("at"), F.lit(None).cast("long").alias("seq"), "size").unionByName(asked.withColumn("size", F.lit(None).cast("long")))
    cut = F.floor((F.col("at") - S.FIRST_SEQ) * batches / 100)

    def run(stream):
        return live.live_repairs(stream.filter("size is not null").withColumnRenamed("at", "ext_seq"), stream.filter("size is null"), 64, ttl)

    got = live.played(both.withColumn("cut", cut), "cut", str(tmp_path), run, live.REPAIRS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20

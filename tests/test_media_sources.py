"""Readers and writers of packets and benchmark files on small and faulty inputs."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from tributary.operators import quality as Q
from tributary.sources import bench as H
from tributary.sources import containers as K
from tributary.sources import payloads as P
from tributary.sources import rtcp as RC


def rows(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "k int, content binary")


def test_payload_faults(spark):
    got = P.payload_elements(rows(spark, b"", b"\x11x", b"\x88a", b"\x10abc", b"\x20\x01ab", b"\x00\x05ab", b"\x10", b"\x50", b"\x00\x00", b"\x10\x00")).orderBy("k", "idx").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r.error or bytes(r.data))
    assert by == {0: ["short payload"], 1: ["reserved bit is set"], 2: ["a new sequence can't continue an element"], 3: [b"abc"], 4: [b"a", b"b"], 5: ["short payload"], 6: ["empty element"], 7: [b""], 8: ["empty element"], 9: [b"\x00"]}


def test_reassembly_needs_every_fragment(spark):
    """A unit in three packets is whole only with all of them; a continuation without a start is none."""
    parts = [(1, b"\x50ab"), (2, b"\xd0cd"), (3, b"\x90ef"), (4, b"\x10gh")]
    for lost, want in ((None, [b"abcdef", b"gh"]), (1, [b"gh"]), (2, [b"gh"]), (3, [b"gh"]), (4, [b"abcdef"])):
        df = spark.createDataFrame([(7, s, bytearray(c)) for s, c in parts if s != lost], "ssrc long, ext_seq long, payload binary")
        got = P.reassembled(df).filter("complete").orderBy("first_seq").collect()
        assert [bytes(r.data) for r in got] == want, lost


@pytest.mark.parametrize("limit", [20, 100, 1200])
def test_packing_keeps_every_byte(spark, limit):
    sizes = [1, 300, 5, 5, 5, 5, 1190, 2, 64, 1201]
    units = [bytes([i]) * n for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(1, [bytearray(u) for u in units], True), (2, [], True), (3, None, False)], "p int, units array<binary>, key boolean")
    packets = P.packed(df, "units", limit, 6, 6, "key")
    listed = packets.orderBy("packet").collect()
    assert all(len(r.payload) <= limit for r in listed) and [r.marker for r in listed] == [False] * (len(listed) - 1) + [True]
    assert [bool(r.payload[0] & 8) for r in listed] == [True] + [False] * (len(listed) - 1)
    got = P.reassembled(packets.withColumnRenamed("packet", "ext_seq"), "p").filter("complete")
    assert sorted(bytes(r.data) for r in got.collect()) == sorted(units)


def test_control_faults(spark):
    sdes = spark.range(1).select(RC.source_description(F.array(F.struct(F.lit(1).alias("ssrc"), F.array(F.struct(F.lit(1).alias("type"), F.lit("é").alias("text"))).alias("items")))).alias("b")).first().b
    got = RC.rtcp_packets(rows(spark, b"\x80", b"\x00\xc8\x00\x00", bytes(sdes) + b"\x81\xcb", bytes(sdes)[:6])).orderBy("k", "idx").collect()
    assert [(r.k, r.error is None) for r in got] == [(0, False), (1, False), (2, False), (2, True), (3, False)] or {(r.k, r.error is None) for r in got} == {(0, False), (1, False), (2, True), (2, False), (3, False)}
    assert [r.chunks[0]["items"][0].text for r in got if r.chunks] == ["é"]


def test_records_and_raw_faults(spark):
    got = H.length_prefixed(rows(spark, b"", b"\x01\x00\x00\x00a\x00\x00\x00\x00", b"\x05\x00\x00\x00a")).orderBy("k", "idx").collect()
    assert sorted((r.k, r.error or bytes(r.payload)) for r in got if r.k != 1) == [(0, "no payloads"), (2, "truncated payload")]
    assert {r.error or bytes(r.payload) for r in got if r.k == 1} == {b"a", "empty payload"}
    frames = H.i420_frames(rows(spark, b"x" * 6, b"x" * 7, b""), 2, 2).orderBy("k").collect()
    assert [(r.k, r.frame, r.error) for r in frames] == [(0, 0, None), (1, None, "size is not a number of frames"), (2, None, "size is not a number of frames")]


def test_units_get_a_size(spark):
    raw = [b"\x0a\x01z", b"\x08zz", b"\x0c\x20zz", b"", b"\x0c"]
    got = [r[0] and bytes(r[0]) for r in rows(spark, *raw).orderBy("k").select(K.resized(F.col("content"))).collect()]
    assert got == [b"\x0a\x01z", b"\x0a\x02zz", b"\x0e\x20\x02zz", None, None]


def test_manifest_and_results_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name, input,width,height,frames,url\na,x/a.yuv,64,48,3,u\n,x/b.yuv,64,48,3,\na,x/c.yuv,64,48,3,\nA ,q,62,20,1,\nc?,q,63,20,1,\nd,q,64,20,x,\n")
    got = H.read_manifest(spark, str(tmp_path / "m.csv"), 25).orderBy("row").collect()
    assert [(r.clip, r.fps, r.source_url, r.error) for r in got] == [("a", 25, "u", None), ("b.yuv", 25, "", None), ("a", 25, "", "clip name is repeated"), ("A", 25, "", "folder name collides"), ("c?", 25, "", "frame size is not even and at least 16"), ("d", 25, "", "frames is not a positive integer")]
    with pytest.raises(ValueError, match="width"):
        H.clips(spark.createDataFrame([(1, "x", "3", "4")], "row int, input string, height string, frames string"), "row")
    H.write_results(spark.createDataFrame([("a,b", 64, "ok")], "clip string, width int, status string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    lines = list(csv.reader(part.open()))
    assert lines[0] == list(H.RESULT) and lines[1][0] == "a,b" and lines[1][1] == "64" and lines[1][19] == "ok"


def test_flattened_and_documents(spark):
    df = spark.createDataFrame([("x", [1, 2]), ("y", [3])], "clip string, hits array<int>")
    assert [tuple(r) for r in H.flattened(df, {"hits": 2}).orderBy("clip").collect()] == [("x", 1, 2), ("y", 3, None)]
    doc = H.metadata_json(df.withColumn("run", F.lit(1)), ["run"], ["clip"]).first().document
    assert json.loads(doc) == {"run": 1, "clips": [{"clip": "x"}, {"clip": "y"}]}


def test_curves_with_faults(spark):
    """Each fault of a curve has a status; sound ones have a rate difference."""
    anchor = [("A", m, r) for m, r in ((30.0, 1e5), (35.0, 2e5), (40.0, 4e5), (45.0, 8e5))]
    curves = {
        "same": [(m, r) for _, m, r in anchor], "twice": [(m, 2 * r) for _, m, r in anchor], "half": [(m, r / 2) for _, m, r in anchor], "few": [(30.0, 1e5)], "bad": [(30.0, -1.0), (31.0, 2.0), (32.0, 3.0), (33.0, 4.0)],
        "nan": [(float("nan"), 1.0), (31.0, 2.0), (32.0, 3.0), (33.0, 4.0)], "repeats": [(30.0, 1.0), (30.0, 2.0), (32.0, 3.0), (33.0, 4.0)], "apart": [(50.0, 1.0), (51.0, 2.0), (52.0, 3.0), (53.0, 4.0)],
    }
    points = [("c", e, m, r) for e, m, r in anchor] + [("c", e, m, r) for e, p in curves.items() for m, r in p] + [("lone", "same", 1.0, 2.0)]
    got = {(r.clip, r.encoder): (r.status, r.bd_rate) for r in Q.bd_rate(spark.createDataFrame(points, "clip string, encoder string, metric double, rate double"), "A").collect()}
    assert got == {
        ("c", "same"): ("ok", 0.0), ("c", "twice"): ("ok", 100.0), ("c", "half"): ("ok", -50.0), ("c", "few"): ("too few points", None), ("c", "bad"): ("invalid point", None), ("c", "nan"): ("invalid point", None),
        ("c", "repeats"): ("repeated metric", None), ("c", "apart"): ("no overlap", None), ("lone", "same"): ("no anchor", None),
    }

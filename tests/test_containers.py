"""Byte vectors and faults of the container and packet readers."""

import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.functions import columns as C
from tributary.sources import containers as K
from tributary.sources import rtcp as RC


def frame(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "k int, content binary")


IVF = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 16, 16, 30, 1, 1, 0) + struct.pack("<IQ", 2, 0) + b"\x12\x00"


def test_ivf_single_frame_and_faults(spark):
    rows = K.ivf_frames(frame(spark, IVF, IVF[:-1], b"RIFF" + IVF[4:], b"")).orderBy("k").collect()
    assert [(r.k, r.payload and bytes(r.payload), r.error) for r in rows] == [(0, b"\x12\x00", None), (1, None, "truncated frame"), (2, None, "not an IVF file of this codec"), (3, None, "truncated file header")]
    assert (rows[0].width, rows[0].timebase_den, rows[0].frame_count) == (16, 30, 1)


def test_read_ivf_files(spark, tmp_path):
    (tmp_path / "a.ivf").write_bytes(IVF)
    assert K.read_ivf(spark, str(tmp_path)).select("idx", "pts").collect() == [(0, 0)]


def test_units(spark):
    sequence = bytes.fromhex("0a0b00000004457e3efffcc020")
    rows = K.low_overhead_units(frame(spark, b"\x12\x00" + sequence, b"\x92\x00", b"\x12\x05")).orderBy("k", "idx").collect()
    assert [(r.k, r.type, r.error) for r in rows if not r.error] == [(0, 2, None), (0, 1, None)]
    assert {(r.k, r.error) for r in rows if r.error} == {(1, "forbidden bit is set"), (2, "truncated unit")}
    assert len([r for r in rows if r.type == 1][0].payload) == 11


def test_annexb_nesting(spark):
    unit = b"\x10"
    good = bytes([len(unit) + 2, len(unit) + 1, len(unit)]) + unit
    rows = K.annexb_units(frame(spark, good, good[:-1], bytes([1, 5]))).orderBy("k").collect()
    assert (rows[0].type, rows[0].temporal_unit, rows[0].frame_unit, rows[0].error) == (2, 0, 0, None)
    assert all(r.error for r in rows[1:]) and len(rows) == 3


def test_rtp_extensions_and_padding(spark):
    head = struct.pack(">BBHII", 0xB1, 0x80 | 96, 65535, 7, 9) + struct.pack(">I", 5) + struct.pack(">HH", 0xBEDE, 1) + b"\x10\xaa\x00\x00"
    r = K.rtp_packets(frame(spark, head + b"pay" + b"\x00\x02")).collect()[0]
    assert (r.marker, r.payload_type, r.seq, r.csrc, bytes(r.payload), r.error) == (True, 96, 65535, [5], b"pay", None)
    assert [(e.id, bytes(e.payload)) for e in r.extensions] == [(1, b"\xaa")]
    bad = K.rtp_packets(frame(spark, head + b"p" + b"\xff", b"\x40" + head[1:])).collect()
    assert [b.error for b in bad] == ["padding beyond the payload", "not version 2"]


def test_rtcp_compound(spark):
    report = struct.pack(">BBHI", 0x81, 201, 7, 1) + struct.pack(">IIIIII", 2, (25 << 24) | 0xFFFFFF, 3, 4, 5, 6)
    nack = struct.pack(">BBHII", 0x81, 205, 3, 1, 2) + struct.pack(">HH", 10, 3)
    rows = RC.rtcp_packets(frame(spark, report + nack, report[:-1])).orderBy("k", "idx").collect()
    good = [r for r in rows if r.k == 0]
    assert (good[0].reports[0].lost, good[0].reports[0].fraction_lost) == (-1, 25)
    assert [(n.pid, n.mask) for n in good[1].nacks] == [(10, 3)]
    assert any(r.error for r in rows if r.k == 1)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=20))
def test_leb128_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", C.leb128_bytes(F.col("v")))
    for v, b, back in df.select("v", "b", C.leb128_value(F.col("b"))).collect():
        assert back == v and K.leb128(bytes(b), 0) == (v, len(b))

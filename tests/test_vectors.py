"""Literal bytes of control packets and header extensions, written and read."""

import pytest
from pyspark.sql import functions as F

from tributary.sources import payloads as P
from tributary.sources import rtcp as RC

SENDER = bytes.fromhex("82c8001211223344010203040506070809" "0a0b0c0d0e0f101112131422334455" "07fffffd01020304" "05060708090a0b0c0d0e0f10aabbccddee123456" "01000002030000040500000607000008")
RECEIVER = bytes.fromhex("81c90007102030400102030420" "7fffff11121314212223243132333441424344")
DESCRIPTION = bytes.fromhex("82ca0007111111110105") + b"alice" + bytes.fromhex("0605") + b"tools" + bytes.fromhex("0000" "22222222" "0101") + b"b" + b"\0"
LEAVING = bytes.fromhex("82cb0004" "11111111" "22222222" "04") + b"done" + bytes(3)
LOSS = bytes.fromhex("81ce00021122334455667788")
ESTIMATE = bytes.fromhex("8fce00071234567800000000") + b"REMB" + bytes.fromhex("0307fb93234567892345678a2345678b")
TRANSPORT = bytes.fromhex("afcd00060102030405060708" "00010005" "0102037a" "b200" "040404" "000003")
LOST = bytes.fromhex("81cd0004" "0102030405060708" "12348001fffe0003")


def written(spark, *columns):
    return [bytes(x) for x in spark.range(1).select(*columns).first()]


def read(spark, *packets):
    df = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(packets)], "k int, content binary")
    return RC.rtcp_packets(df).orderBy("k", "idx").collect()


def lit(n):
    return F.lit(n).cast("long")


def test_reports(spark):
    block = lambda s, f, lost, *rest: F.struct(lit(s).alias("ssrc"), lit(f).alias("fraction_lost"), lit(lost).alias("lost"), *[lit(v).alias(k) for k, v in zip(("highest", "jitter", "lsr", "delay"), rest, strict=True)])
    both = F.array(block(0x22334455, 7, -3, 0x01020304, 0x05060708, 0x090A0B0C, 0x0D0E0F10), block(0xAABBCCDD, 0xEE, 0x123456, 0x01000002, 0x03000004, 0x05000006, 0x07000008))
    one = F.array(block(0x01020304, 0x20, 0x7FFFFF, 0x11121314, 0x21222324, 0x31323334, 0x41424344))
    out = written(spark, RC.sender_report(lit(0x11223344), lit(0x01020304), lit(0x05060708), lit(0x090A0B0C), lit(0x0D0E0F10), lit(0x11121314), both), RC.receiver_report(lit(0x10203040), one))
    assert out == [SENDER, RECEIVER]
    s, r = read(spark, SENDER, RECEIVER)
    assert (s.type, s.ssrc, s.sender.octets, [x.lost for x in s.reports], s.reports[1].fraction_lost) == (200, 0x11223344, 0x11121314, [-3, 0x123456], 0xEE)
    assert (r.type, r.ssrc, r.reports[0].lost, r.reports[0].delay) == (201, 0x10203040, 0x7FFFFF, 0x41424344)


def test_descriptions_and_goodbyes(spark):
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(text).alias("text"))
    chunks = F.array(F.struct(lit(0x11111111).alias("ssrc"), F.array(item(1, "alice"), item(6, "tools")).alias("items")), F.struct(lit(0x22222222).alias("ssrc"), F.array(item(1, "b")).alias("items")))
    assert written(spark, RC.source_description(chunks), RC.bye(F.array(lit(0x11111111), lit(0x22222222)), F.lit("done"))) == [DESCRIPTION, LEAVING]
    d, b = read(spark, DESCRIPTION, LEAVING)
    assert [(c.ssrc, [(i.type, i.text) for i in c["items"]]) for c in d.chunks] == [(0x11111111, [(1, "alice"), (6, "tools")]), (0x22222222, [(1, "b")])]
    assert (list(b.sources), b.reason) == ([0x11111111, 0x22222222], "done")


def test_feedback(spark):
    pairs = F.array(*[F.struct(F.lit(p).alias("pid"), F.lit(m).alias("mask")) for p, m in ((0x1234, 0x8001), (0xFFFE, 3))])
    sources = F.array(lit(0x23456789), lit(0x2345678A), lit(0x2345678B))
    rate = 0x3FB93 << 1
    assert written(spark, RC.picture_loss(lit(0x11223344), lit(0x55667788)), RC.estimated_bitrate(lit(rate), sources, lit(0x12345678)), RC.nack_bytes(pairs, lit(0x01020304), lit(0x05060708))) == [LOSS, ESTIMATE, LOST]
    loss, estimate, transport, lost = read(spark, LOSS, ESTIMATE, TRANSPORT, LOST)
    assert (loss.type, loss["count"], loss.media_ssrc) == (206, 1, 0x55667788)
    assert (estimate.remb.bitrate, list(estimate.remb.sources)) == (rate, [0x23456789, 0x2345678A, 0x2345678B])
    assert (transport.twcc.base_seq, list(transport.twcc.ticks)) == (1, [4, 4, None, None, 4])
    assert [(n.pid, n.mask) for n in lost.nacks] == [(0x1234, 0x8001), (0xFFFE, 3)]


def test_layer_refresh(spark):
    entry = F.struct(lit(0x0A0B0C0D).alias("ssrc"), F.lit(9).alias("seq"), *[F.lit(v).alias(f"{p}_{k}") for p, v3 in (("target", (5, 2)), ("current", (1, 0))) for k, v in zip(("temporal", "spatial"), v3, strict=True)])
    [data] = written(spark, RC.layer_refresh(F.array(entry), lit(1)))
    assert data == bytes.fromhex("8ace0005" "00000001" "00000000" "0a0b0c0d" "0900" "0502" "0100" "0000")
    [r] = read(spark, data)
    assert (r.refresh[0].target_temporal, r.refresh[0].target_spatial, r.refresh[0].current_temporal, r.refresh[0].seq) == (5, 2, 1, 9)


@pytest.mark.parametrize("kind,values,data", [
    ("video_orientation", {"reserved": 0, "camera": 1, "flip": 1, "rotation": 3}, "0f"), ("playout_delay", {"minimum": 12, "maximum": 345}, "00c159"), ("transport_sequence_2", {"seq": 0xABCD, "timed": 1, "count": 0x1234}, "abcd9234"), ("transport_sequence", {"seq": 0x1234}, "1234"),
    ("absolute_send_time", {"seconds": 0x3F, "fraction": 0x3FFFF}, "ffffff"), ("video_content", {"kind": 1}, "01"), ("audio_level", {"voice": 1, "level": 37}, "a5"), ("capture_time", {"seconds": 0x11121314, "fraction": 0x15161718}, "1112131415161718"),
    ("video_timing", {"flags": 3, "encode_start": 1, "encode_finish": 2, "packetized": 3, "pacer_exit": 4, "network": 5, "network_2": 0x0607}, "03000100020003000400050607"),
])
def test_header_extensions(spark, kind, values, data):
    [out] = written(spark, P.extension_bytes(kind, {k: F.lit(v) for k, v in values.items()}))
    assert out.hex() == data
    found = P.extension_values(kind, F.lit(bytearray.fromhex(data)))
    assert spark.range(1).select(*[found[k].alias(k) for k in values]).first().asDict() == values
    short = P.extension_values(kind, F.lit(bytearray.fromhex(data)[:-1]))
    assert set(spark.range(1).select(*[short[k].alias(k) for k in values]).first()) == {None}

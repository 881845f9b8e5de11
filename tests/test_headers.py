"""Byte vectors and faults of sequence headers, metadata units, dependency descriptors and layer allocations."""

import pytest
from pyspark.sql import functions as F

from tributary.sources import bits as W
from tributary.sources import descriptor as D
from tributary.sources import headers as H


def packed(*fields):
    """(value, width) pairs as bytes."""
    text = "".join(f"{v:0{n}b}" if n else "" for v, n in fields)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def trailed(*fields):
    return packed(*fields, (1, 1))


def frame(spark, *contents):
    return spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(contents)], "k int, payload binary")


# --- sequence headers ------------------------------------------------------------------------------


def still(level=5):
    return trailed((0, 3), (1, 1), (1, 1), (level, 5), (3, 4), (3, 4), (15, 4), (8, 4), (1, 1), (0, 1), (1, 1), (0, 1), (1, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (1, 2), (1, 1), (0, 1))


def moving(level=5, ids=None, points=((0, 0),)):
    head = [(0, 3), (0, 1), (0, 1), (0, 1), (0, 1), (len(points) - 1, 5)]
    for idc, tier in points:
        head += [(idc, 12), (level, 5)] + ([(tier, 1)] if level > 7 else [])
    id_bits = [(0, 1)] if ids is None else [(1, 1), (ids[0], 4), (ids[1], 3)]
    tools = [(1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (0, 1), (1, 1), (1, 1), (6, 3), (1, 1), (1, 1), (1, 1)]
    colours = [(0, 1), (0, 1), (1, 1), (1, 8), (13, 8), (0, 8), (0, 1)]
    return trailed(*head, (10, 4), (9, 4), (1279, 11), (719, 10), *id_bits, *tools, *colours, (1, 1))


def test_sequence_header_of_a_still_picture():
    s = H.sequence(still())
    assert (s["profile"], s["still_picture"], s["reduced"], len(s["points"]), s["points"][0]["level"]) == (0, True, True, 1, 5)
    assert (s["max_width"], s["max_height"], s["bit_depth"], s["subsampling_x"], s["subsampling_y"], s["chroma_position"], s["separate_uv"]) == (16, 9, 8, True, True, 1, True)
    assert (s["screen_content"], s["integer_motion"]) == (2, 2)


def test_sequence_header_of_a_video():
    s = H.sequence(moving())
    assert (s["max_width"], s["max_height"], s["order_hint_bits"], s["superres"], s["cdef"], s["restoration"], s["film_grain"]) == (1280, 720, 7, True, True, True, True)
    assert (s["full_range"], s["subsampling_x"], s["subsampling_y"], s["screen_content"], s["integer_motion"]) == (True, False, False, 2, 2)
    points = H.sequence(moving(8, points=tuple((k, k % 2) for k in range(32))))["points"]
    assert [(p["idc"], p["tier"]) for p in points] == [(k, k % 2) for k in range(32)]
    ids = H.sequence(moving(ids=(13, 0)))
    assert (ids["delta_frame_id_bits"], ids["more_frame_id_bits"]) == (15, 1)


def test_sequence_header_of_a_published_stream():
    s = H.sequence(bytes.fromhex("00000004457e3efffcc020"))
    assert (s["profile"], s["reduced"], s["bit_depth"]) == (0, False, 8) and s["max_width"] > 0


def test_timing_and_decoder_model():
    head = [(2, 3), (0, 1), (0, 1), (1, 1), (1001, 32), (60000, 32), (1, 1), (0b00101, 5), (1, 1), (9, 5), (77, 32), (4, 5), (5, 5)]
    point = [(1, 1), (1, 5), (0x101, 12), (9, 5), (1, 1), (1, 1), (500, 10), (600, 10), (1, 1), (1, 1), (7, 4), (0x303, 12), (4, 5), (0, 1), (0, 1)]
    tail = [(0, 4), (0, 4), (1, 1), (0, 1), (0, 1), (0, 3), (0, 4), (0, 1), (0, 1), (0, 1), (0, 3), (1, 1), (1, 1), (0, 1), (0, 1), (0, 1), (1, 1), (0, 1), (0, 1), (0, 1)]
    s = H.sequence(trailed(*head, *point, *tail))
    assert (s["units_in_tick"], s["time_scale"], s["ticks_per_picture"], s["buffer_delay_bits"], s["decoding_tick"]) == (1001, 60000, 5, 10, 77)
    assert s["points"][0] == {"idc": 0x101, "level": 9, "tier": 1, "decoder_delay": 500, "encoder_delay": 600, "low_delay": True, "display_delay": 8}
    assert s["points"][1] == {"idc": 0x303, "level": 4, "tier": 0} and (s["bit_depth"], s["subsampling_x"], s["subsampling_y"]) == (12, True, False)


@pytest.mark.parametrize("data,error", [
    (b"\xe0", "profile is not defined"), (b"", "short payload"), (still(2), "level is not defined"), (moving(10), "level is not defined"), (moving(28), "level is not defined"), (moving(ids=(14, 0)), "frame id of more than 16 bits"),
    (packed((0, 3), (0, 1), (1, 1), (0, 3)), "a reduced header is for still pictures"), (still()[:-1], "short payload"), (still() + b"\x01", "trailing bits"),
])
def test_faults_of_sequence_headers(data, error):
    with pytest.raises(ValueError, match=error):
        H.sequence(data)


def test_sequence_headers_as_columns(spark):
    rows = H.sequence_headers(frame(spark, still(), moving(), b"\xe0", None)).orderBy("k").collect()
    assert [(r.k, r.max_width, r.error) for r in rows] == [(0, 16, None), (1, 1280, None), (2, None, "profile is not defined")]
    assert rows[1].points[0].level == 5 and rows[1].units_in_tick is None


# --- metadata --------------------------------------------------------------------------------------

MASTERING = bytes(range(16)) + (10**7).to_bytes(4, "big") + (50).to_bytes(4, "big")


def test_metadata_of_every_kind():
    assert H.metadata(b"\x01\x03\xe8\x01\x90\x80")["light"] == {"max_content": 1000, "max_average": 400}
    m = H.metadata(b"\x02" + MASTERING + b"\x80\x00")["mastering"]
    assert m["primaries"][1] == {"x": 0x0405, "y": 0x0607} and (m["white_x"], m["white_y"], m["luminance_max"], m["luminance_min"]) == (0x0C0D, 0x0E0F, 10**7, 50)
    assert H.metadata(b"\x04\xb5ABC\x80")["message"] == {"country": 0xB5, "extension": None, "payload": b"ABC"}
    assert H.metadata(b"\x04\xff\x42X\x80")["message"] == {"country": 255, "extension": 0x42, "payload": b"X"}
    assert H.metadata(b"\x03\x04\x80")["scalability"] == {"mode": 4}
    group = [(1, 3), (1, 1), (0, 1), (2, 3), (5, 8), (6, 8), (0, 3), (0, 1), (1, 1), (0, 3)]
    s = H.metadata(b"\x03" + trailed((14, 8), (1, 2), (1, 1), (1, 1), (1, 1), (0, 3), (320, 16), (180, 16), (640, 16), (360, 16), (255, 8), (0, 8), (2, 8), *group))["scalability"]
    assert s["layers"] == 2 and s["dimensions"][1] == {"width": 640, "height": 360} and s["references"] == [255, 0]
    assert s["group"] == [{"temporal_id": 1, "temporal_up": True, "spatial_up": False, "differences": [5, 6]}, {"temporal_id": 0, "temporal_up": False, "spatial_up": True, "differences": []}]
    t = H.metadata(b"\x05" + trailed((3, 5), (1, 1), (0, 1), (1, 1), (300, 9), (59, 6), (58, 6), (23, 5), (4, 5), (9, 4)))["timecode"]
    assert (t["seconds"], t["minutes"], t["hours"], t["offset_bits"], t["offset"], t["dropped"]) == (59, 58, 23, 4, 9, True)
    t = H.metadata(b"\x05" + trailed((0, 5), (0, 1), (0, 1), (0, 1), (1, 9), (1, 1), (7, 6), (0, 1), (0, 5)))["timecode"]
    assert t["seconds"] == 7 and "minutes" not in t and t["offset"] == 0
    assert H.metadata(b"\x20\x01\x80") == {"type": 32, "raw": b"\x01\x80"} and H.metadata(b"\x80\x01\x80") == {"type": 128, "raw": b"\x80"}


@pytest.mark.parametrize("data,error", [
    (b"", "short payload"), (b"\x04", "no country code"), (b"\x04\xff", "no country code"), (b"\x04\xb5\0\0", "no trailing bits"), (b"\x04\xb5A\x40", "trailing bits"), (b"\x01\x03", "short payload"),
    (b"\x01\x03\xe8\x01\x90", "no trailing bits"), (b"\x01\x03\xe8\x01\x90\x81", "trailing bits"), (b"\x02" + MASTERING[:-1], "short payload"), (b"\x03\x0e", "short payload"), (b"\x03\x04", "short payload"), (b"\x03\x04\x40", "trailing bits"),
    (b"\x05\x00", "short payload"), (b"\x20", "no trailing bits"), (b"\x20\0", "no trailing bits"), (b"\x80", "truncated size"),
])
def test_faults_of_metadata(data, error):
    with pytest.raises(ValueError, match=error):
        H.metadata(data)


def test_metadata_as_a_union(spark):
    rows = H.metadata_units(frame(spark, b"\x01\x03\xe8\x01\x90\x80", b"\x04\xb5ABC\x80", b"\x20\x07\x80", b"\x04", None))
    got = H.as_variant(rows).select("k", "kind", F.variant_get("body", "$.max_content", "int").alias("c"), F.variant_get("body", "$.country", "int").alias("n"), "raw", "error").orderBy("k").collect()
    assert [(r.k, r.kind, r.c, r.n, r.raw and bytes(r.raw), r.error) for r in got] == [(0, "light", 1000, None, None, None), (1, "message", None, 181, None, None), (2, None, None, None, b"\x07\x80", None), (3, None, None, None, None, "no country code")]


# --- dependency descriptors ------------------------------------------------------------------------

#: One template of a structure that begins at number 3: one target, switch.
ATTACHED = packed((1, 1), (1, 1), (3, 6), (1, 16), (1, 1), (0, 4), (3, 6), (0, 5), (3, 2), (2, 2), (0, 1), (0, 1), (0, 1))
#: Two spatial layers, two targets and chains, beginning at 5, with sizes.
LAYERED = packed((1, 1), (0, 1), (5, 6), (9, 16), (1, 1), (0, 4), (5, 6), (1, 5), (2, 2), (3, 2), (2, 2), (3, 2), (0, 2), (2, 2), (0, 1), (1, 1), (0, 4), (0, 1), (3, 2), (0, 1), (1, 1), (1, 4), (2, 4), (3, 4), (4, 4), (1, 1), (319, 16), (179, 16), (639, 16), (359, 16))


def test_structure_and_custom_fields():
    own = D.decode(LAYERED)
    assert own["structure"]["chains"] == 2 and own["protected_by"] == [0, 1] and (own["width"], own["mask"]) == (320, 3)
    custom = packed((3, 2), (6, 6), (200, 16), (0, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 2), (3, 2), (0, 2), (2, 2), (16, 8), (0, 2), (9, 8), (10, 8))
    d = D.decode(custom, own["structure"])
    assert (d["first_packet"], d["last_packet"], d["template"], d["frame"], d["attached"], d["mask"]) == (True, True, 6, 200, False, 1)
    assert (d["spatial_id"], d["temporal_id"], d["indications"], d["differences"], d["chains"]) == (1, 0, [3, 0], [17], [9, 10])
    assert (d["width"], d["height"], d["consumed"]) == (640, 360, len(custom))
    plain = D.decode(b"\x46\x00\x01", own["structure"])
    assert (plain["indications"], plain["differences"], plain["chains"], plain.get("mask")) == ([0, 2], [1], [3, 4], None)


@pytest.mark.parametrize("data,known,error", [
    (b"\xc0\0", None, "short payload"), (b"\xc0\0\1", None, "no structure"), (b"\xc0\0\1\x80", None, "short payload"), (b"\xc5\0\1", D.decode(ATTACHED)["structure"], "no such template"), (b"\xc3\0\1\0", None, "no structure"),
    (packed((3, 2), (3, 6), (1, 16), (1, 1), (0, 4), (3, 6), (0, 5), *[(2, 2)] * 4), None, "too many layers"), (packed((3, 2), (3, 6), (1, 16), (1, 1), (0, 4), (3, 6), (0, 5), *[(0, 2)] * 64), None, "too many layers"),
])
def test_faults_of_descriptors(data, known, error):
    with pytest.raises(ValueError, match=error):
        D.decode(data, known)


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_structures_persist_over_a_stream(spark, piece):
    """Equal to taking the packets of each stream one by one."""
    masked = packed((3, 2), (3, 6), (3, 16), (0, 1), (1, 1), (0, 3), (0, 1))
    kinds = [ATTACHED, LAYERED, b"\xc3\0\2", b"\x46\0\1", b"\xc5\0\7", masked, b"\xc0", LAYERED[:9], None, ATTACHED[:3] + b"\x80"]
    rows = [(s, q, None if (x := kinds[(q * 7 + q // 5 + s) % 10]) is None else bytearray(x)) for s in (1, 2) for q in range(60)] + [(None, 0, bytearray(ATTACHED)), (None, 1, bytearray(b"\xc3\0\2"))]
    df = spark.createDataFrame(rows, "ssrc int, ext_seq long, descriptor binary").repartition(5).withColumn("extra", F.lit(1))
    got = {(r.ssrc, r.ext_seq): r for r in D.dependency_descriptors(df, piece=piece).collect()}
    assert len(got) == len(rows)
    for stream in (1, 2, None):
        known = active = None
        for s, q, data in sorted((r for r in rows if r[0] == stream), key=lambda r: r[1]):
            r = got[s, q]
            try:
                want = {} if data is None else D.decode(bytes(data), known)
                error = None
            except ValueError as e:
                want, error = {}, str(e)
            known, active = want.get("structure", known), want.get("mask", active)
            assert (r.error, r.active, r.mask, r.indications, r.width) == (error, active, want.get("mask"), want.get("indications"), want.get("width")), (s, q)


def test_bits_are_written_as_they_are_read(spark):
    df = spark.range(40).select("id", W.packed(F.concat(W.among(F.col("id") % 5, F.lit(5)), W.field(F.col("id"), 7), W.flag(F.col("id") % 3 == 0), W.uvlc(F.col("id") * 1000)), trailing=True).alias("b"))
    for r in df.collect():
        b = W.Bits(bytes(r.b))
        assert (b.among(5), b.take(7), b.flag(), b.uvlc()) == (r.id % 5, r.id, r.id % 3 == 0, r.id * 1000)
        b.trailing()


# --- layer allocations -----------------------------------------------------------------------------


def layer(stream, spatial, kbps, size=(None, None, None)):
    return (stream, spatial, kbps, *size)


THREE = [layer(0, 0, [150]), layer(1, 0, [240, 400]), layer(2, 0, [720, 1200])]
SIZED = [layer(0, 0, [150], (320, 180, 30)), layer(1, 0, [240, 400], (640, 360, 30)), layer(2, 0, [720, 1200], (1280, 720, 30))]
VECTORS = [(0, 3, THREE, False, "21149601f0019003d005b009"), (2, 3, SIZED, True, "a1149601f0019003d005b009013f00b31e027f01671e04ff02cf1e"), (1, 3, [SIZED[2], SIZED[0]], True, "601010109601d005b009013f00b31e04ff02cf1e"), (0, 1, [], False, "00")]
SCHEMA = "k int, stream int, streams int, layers array<struct<stream:int,spatial_id:int,kbps:array<long>,width:int,height:int,framerate:int>>, sized boolean"


def test_allocations_in_bytes_and_back(spark):
    more = [(0, 1, [layer(0, 0, [90]), layer(0, 1, [180, 260]), layer(0, 2, [360, 520, 700])], False), (3, 4, [layer(s, k, [1] * (k + 1)) for s in range(4) for k in range(s + 1)], False)]
    cases = [v[:4] for v in VECTORS] + more
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], SCHEMA)
    coded = df.select("k", D.allocation_bytes(*map(F.col, ("stream", "streams", "layers", "sized"))).alias("content")).orderBy("k")
    assert [bytes(r.content).hex() for r in coded.collect()[: len(VECTORS)]] == [v[4] for v in VECTORS]
    for r, (stream, streams, layers, sized) in zip(D.layer_allocations(coded).orderBy("k").collect(), cases, strict=True):
        assert (r.stream, r.streams, r.sized, [tuple(x) for x in r.layers], r.error) == (stream, streams, sized, sorted(layers), None)


def test_allocations_that_break_the_rules(spark):
    bad = [(1, 1, [], False), (0, 2, [], False), (0, 1, [], True), (0, 0, THREE[:1], False), (0, 5, THREE[:1], False), (3, 3, THREE, False), (0, 2, THREE, False), (0, 1, [layer(0, 4, [1])], False), (0, 1, [layer(0, 0, [1])] * 2, False), (0, 1, [layer(0, 0, [])], False),
           (0, 1, [layer(0, 0, [1] * 5)], False), (0, 1, [layer(0, 0, [1], (1, 1, 256))], True), (0, 1, [layer(0, 0, [1], (0, 1, 1))], True), (0, 1, [layer(0, 0, [1], (1, 1, 1))], False), (0, 1, [layer(0, 0, [-1])], False)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(bad)], SCHEMA)
    assert [r[0] for r in df.select(D.allocation_bytes(*map(F.col, ("stream", "streams", "layers", "sized")))).collect()] == [None] * len(bad)


@pytest.mark.parametrize("data,error", [
    (b"", "short payload"), (b"\x40", "no such stream"), (b"\0\0", "no layers"), (b"\0", None), (b"\x01\0\x80", "truncated size"), (b"\x01\0\x96\x01\0", "truncated resolutions"), (b"\x01\0\x96\x01" + bytes(6), "bytes behind the resolutions"), (b"\x01", "short payload"), (b"\x30", "short payload"),
])
def test_faults_of_allocations(data, error):
    if error is None:
        assert D.allocation(data) == {"stream": 0, "streams": 1, "sized": False, "layers": []}
    else:
        with pytest.raises(ValueError, match=error):
            D.allocation(data)

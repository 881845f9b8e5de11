"""Session descriptions: negotiation and emission by literal cases."""

import pytest
from pyspark.sql import functions as F

from tributary.functions import sdp as D
from tributary.operators import descriptions as N

VIDEO = "m=video 9 UDP/TLS/RTP/SAVPF 97 98"


def checked(spark, texts, checks, ids=None):
    df = spark.createDataFrame([(k, "\r\n".join(t) if t is not None else None) for k, t in enumerate(texts)], "k int, text string").withColumn("line", F.lit(1))
    return {r.id: r for r in N.negotiated(N.sections(df, "k", "text"), checks, ids).collect()}


def test_sections_bind_the_codec(spark):
    cases = [
        ([VIDEO, "a=rtpmap:98 AV1/90000"], True), (["v=0", VIDEO.upper(), "A=RTPMAP:98 av1/90000", "a=fmtp:98 profile=9"], False), ([VIDEO, "a=rtpmap:99 AV1/90000"], False), ([VIDEO, "a=rtpmap:98 AV1/48000"], False), ([VIDEO.replace(" 9 ", " 0/2 "), "a=rtpmap:98 AV1/90000"], False),
        (["m=audio 9 RTP 98", "a=rtpmap:98 AV1/90000"], False), (["a=inactive", VIDEO, "a=rtpmap:98 AV1/90000"], False), (["a=inactive", VIDEO, "a=rtpmap:98 AV1/90000", "a=sendonly"], True), (["m=audio 0 RTP 0", VIDEO, "a=rtpmap:97 VP8/90000", "a=rtpmap:98 AV1/90000"], True),
        ([VIDEO, "a=rtpmap:98 AV1/90000", "a=rtpmap:97 AV1/90000", "a=fmtp:98 level-idx=10"], True), (["m=video 9 RTP", "a=rtpmap:98 AV1/90000"], False), (None, None), (["v=0"], None), ([""], None),
    ]
    got = checked(spark, [t for t, _ in cases], {"ok": ("active", N.bound())})
    assert {k: got[k].ok if k in got else None for k in range(len(cases))} == {k: want for k, (_, want) in enumerate(cases)}


def test_sides_and_parameters(spark):
    texts = [[VIDEO, "a=rtpmap:98 AV1/90000", f"a={d}", *more] for d in ("sendonly", "recvonly", "sendrecv") for more in ([], ["a=fmtp:98 profile=2; level-idx=8; tier=1"])]
    checks = {"receive": ("receive", N.bound()), "send": ("send", N.bound()), "low": ("receive", N.params(0, 5, 0)), "high": ("receive", N.params(2, 8, 1)), "wrong": ("receive", N.params(0, 10, 0))}
    got = checked(spark, texts, checks)
    assert [(r.receive, r.send, r.low, r.high, r.wrong) for _, r in sorted(got.items())] == [(False, True, False, False, False)] * 2 + [(True, False, True, False, False), (True, False, True, True, False), (True, True, True, False, False), (True, True, True, True, False)]


def test_feedback_and_extensions(spark):
    base = [VIDEO, "a=rtpmap:98 AV1/90000"]
    uri = "https://example.org/#dependency"
    texts = [[*base, "a=rtcp-fb:98 nack pli"], [*base, "a=rtcp-fb:* NACK  pli"], [*base, "a=rtcp-fb:97 nack pli"], [*base, "a=rtcp-fb:98 nack"], [*base, f"a=extmap:4/recvonly {uri.upper()} attrs", f"a=extmap:5 {uri}"], [*base, "a=recvonly", f"a=extmap:0 {uri}", f"a=extmap:6 {uri}"], [*base, f"a=extmap:7/sendonly {uri}"]]
    checks = {"fb": ("active", N.feedback(" Nack Pli ")), "none": ("active", N.feedback(" ")), "ext": ("receive", N.extension(uri, "receive"))}
    got = checked(spark, texts, checks, {"receive_id": (uri, "receive"), "send_id": (uri, "send")})
    assert [(got[k].fb, got[k].none, got[k].ext, got[k].receive_id, got[k].send_id) for k in range(7)] == [(True, False, False, None, None)] * 2 + [(False, False, False, None, None)] * 2 + [(False, False, True, 4, 5), (False, False, True, 6, None), (False, False, False, None, 7)]


def test_simulcast_and_frames(spark):
    base = [VIDEO, "a=rtpmap:98 AV1/90000"]
    rids = ["a=rid:hi send pt=98;max-width=1280", "a=rid:lo send max-width=320", "a=rid:in recv pt=97"]
    texts = [[*base, *rids, "a=simulcast:send hi;~lo"], [*base, *rids, "a=simulcast:send hi;~lo", "a=simulcast:send hi"], [*base, *rids], [*base, *rids, rids[0], "a=simulcast:send hi"], [*base, *rids, "a=simulcast:recv in"], base, [*base, "a=rid:x send pt=1;max-width=5"], [*base, *rids, "a=simulcast:send hi;hi"]]
    checks = {"any": ("active", N.simulcast()), "recv": ("active", N.simulcast("recv")), "small": ("send", N.frame(300, 200, 30, "send")), "wide": ("send", N.frame(1000, 200, 30, "send")), "huge": ("send", N.frame(2000, 200, 30, "send")), "no": ("send", N.frame(0, 2, 3, "send"))}
    got = checked(spark, texts, checks)
    assert [(got[k].any, got[k].recv, got[k].small, got[k].wide, got[k].huge) for k in range(8)] == [
        (True, False, True, True, False), (False, False, True, True, False), (False, False, True, True, False), (False, False, False, False, False), (False, False, True, True, False), (False, False, True, True, True), (False, False, True, True, True), (False, False, True, True, False)]
    assert [got[k].no for k in (0, 5)] == [False, True]


@pytest.mark.parametrize("line,text", [
    (lambda: N.extmap_line(F.lit(4), F.lit(" urn:x "), F.lit(" RecvOnly"), F.lit("a b ")), "a=extmap:4/recvonly urn:x a b"), (lambda: N.extmap_line(F.lit(0), F.lit("u"), F.lit(""), F.lit("")), None), (lambda: N.extmap_line(F.lit(1), F.lit(" "), F.lit(""), F.lit("")), None),
    (lambda: N.feedback_line(F.lit("98"), F.lit(" NACK  pli")), "a=rtcp-fb:98 nack pli"), (lambda: N.feedback_line(F.lit("128"), F.lit("nack")), None), (lambda: N.feedback_line(F.lit("*"), F.lit("a\nb")), None), (lambda: N.feedback_line(F.lit("*"), F.lit("a(b")), None),
    (lambda: N.rid_line(F.lit("hi"), F.lit("Send"), F.array(F.lit("97"), F.lit(" 98")), {"max-width": F.lit(1280), "max-br": F.lit(0)}), "a=rid:hi send pt=97,98;max-width=1280"), (lambda: N.rid_line(F.lit("hi"), F.lit("both"), F.array().cast("array<string>"), {}), None),
    (lambda: D.attribute_lines(F.lit(98), F.lit(2), F.lit(8), F.lit(1)), "a=rtpmap:98 AV1/90000\na=fmtp:98 profile=2; level-idx=8; tier=1"),
])
def test_lines_written(spark, line, text):
    assert spark.range(1).select(line()).first()[0] == text


def test_written_lines_are_read_back(spark):
    one = lambda r, p=False: F.array(F.struct(F.lit(r).alias("rid"), F.lit(p).alias("paused")))
    text = spark.range(1).select(N.simulcast_line(F.array(one("a"), F.concat(one("b", True), one("c"))), F.array(one("d"))).alias("line"))
    assert text.first()[0] == "a=simulcast:send a;~b,c recv d"
    found = D.simulcast_directions(F.col("line"))
    r = text.select(found["sent"].alias("s"), found["received"].alias("r")).first()
    assert [[(x.rid, x.paused) for x in s] for s in r.s] == [[("a", False)], [("b", True), ("c", False)]] and r.r[0][0].rid == "d"
    assert spark.range(1).select(N.simulcast_line(F.array(one("a"), one("a")), F.array().cast("array<array<struct<rid:string,paused:boolean>>>"))).first()[0] is None

"""Control packets: compound reports are read into one row per packet, writers are column expressions.

A reader gives the packets before a fault and one row with ``error`` set.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.sources.containers import _be, _padded, _scan, _take, joined_bytes

# Packet types and feedback formats.
SENDER, RECEIVER, DESCRIPTION, BYE, TRANSPORT, PAYLOAD = 200, 201, 202, 203, 205, 206
NACK, TWCC, PLI, FIR, LRR, AFB = 1, 15, 1, 4, 10, 15

_REPORT = "struct<ssrc:long,fraction_lost:int,lost:int,highest:long,jitter:long,lsr:long,delay:long>"
FIELDS = (
    "idx int, type int, count int, ssrc long, media_ssrc long, nacks array<struct<pid:int,mask:int>>, "
    f"reports array<{_REPORT}>, sender struct<ntp_sec:long,ntp_frac:long,rtp_time:long,packets:long,octets:long>, "
    "chunks array<struct<ssrc:long,items:array<struct<type:int,text:string>>>>, sources array<long>, reason string, "
    "full_intra array<struct<ssrc:long,seq:int>>, refresh array<struct<ssrc:long,seq:int,target_temporal:int,target_spatial:int,current_temporal:int,current_spatial:int>>, "
    "remb struct<bitrate:long,sources:array<long>>, twcc struct<base_seq:int,count:int,reference:int,number:int,ticks:array<int>>, fci binary"
)


def _reports(body: bytes, at: int, n: int) -> list[dict]:
    out = []
    for k in range(n):
        ssrc, lost, high, jitter, lsr, delay = struct.unpack(">IIIIII", _take(body, at + 24 * k, 24, "report block"))
        out.append({"ssrc": ssrc, "fraction_lost": lost >> 24, "lost": (lost & 0xFFFFFF) - (1 << 24 if lost & 0x800000 else 0), "highest": high, "jitter": jitter, "lsr": lsr, "delay": delay})
    return out


def _chunks(body: bytes, n: int) -> list[dict]:
    out, at = [], 0
    for _ in range(n):
        ssrc, at, items = struct.unpack(">I", _take(body, at, 4, "chunk"))[0], at + 4, []
        while _take(body, at, 1, "chunk")[0]:
            kind, size = _take(body, at, 2, "item")
            items.append({"type": kind, "text": _take(body, at + 2, size, "item").decode("utf-8", "replace")})
            at += 2 + size
        at = (at // 4 + 1) * 4
        out.append({"ssrc": ssrc, "items": items})
    return out


def _feedback_ticks(body: bytes) -> dict:
    """Base, count, reference and number of a transport feedback, and the tick of each packet (null: not received)."""
    base, count, rest = struct.unpack(">HHI", _take(body, 0, 8, "transport feedback"))
    at, kinds = 8, []
    while len(kinds) < count:
        word = struct.unpack(">H", _take(body, at, 2, "status chunk"))[0]
        at += 2
        if word >> 15 == 0:
            kinds += [word >> 13 & 3] * (word & 0x1FFF)
        elif word >> 14 & 1:
            kinds += [word >> s & 3 for s in range(12, -1, -2)]
        else:
            kinds += [word >> s & 1 for s in range(13, -1, -1)]
    ticks = []
    for kind in kinds[:count]:
        if kind == 3:
            raise ValueError("reserved packet status")
        if kind:
            ticks.append(_take(body, at, 1, "tick")[0] if kind == 1 else struct.unpack(">h", _take(body, at, 2, "tick"))[0])
            at += kind
        else:
            ticks.append(None)
    return {"base_seq": base, "count": count, "reference": (rest >> 8) - (1 << 24 if rest >> 31 else 0), "number": rest & 255, "ticks": ticks}


def _fed_back(kind: int, form: int, fci: bytes) -> dict:
    if kind == TRANSPORT and form == NACK:
        return {"nacks": [dict(zip(("pid", "mask"), struct.unpack(">HH", _take(fci, k, 4, "pair")), strict=True)) for k in range(0, len(fci), 4)]}
    if kind == TRANSPORT and form == TWCC:
        return {"twcc": _feedback_ticks(fci)}
    if kind == PAYLOAD and form == FIR:
        return {"full_intra": [{"ssrc": s, "seq": w >> 24} for s, w in struct.iter_unpack(">II", fci)]}
    if kind == PAYLOAD and form == LRR:
        return {"refresh": [{"ssrc": s, "seq": q, "target_temporal": t >> 8 & 7, "target_spatial": t & 3, "current_temporal": c >> 8 & 7, "current_spatial": c & 3} for s, q, _, t, c in struct.iter_unpack(">IBBHHxx", fci)]}
    if kind == PAYLOAD and form == AFB and fci[:4] == b"REMB":
        n, high, low = struct.unpack(">BBH", _take(fci, 4, 4, "bitrate"))
        return {"remb": {"bitrate": ((high & 3) << 16 | low) << (high >> 2), "sources": list(struct.unpack(f">{n}I", _take(fci, 8, 4 * n, "sources")))}}
    return {}


def _rtcp(data: bytes) -> Iterator[dict]:
    at, i = 0, 0
    while at < len(data):
        first, kind, words = struct.unpack(">BBH", _take(data, at, 4, "report header"))
        if first >> 6 != 2:
            raise ValueError("not version 2")
        body, n = _take(data, at + 4, 4 * words, "report"), first & 31
        if first >> 5 & 1:
            if not body or not 0 < body[-1] <= len(body):
                raise ValueError("padding beyond the packet")
            body = body[: len(body) - body[-1]]
        row = {"idx": i, "type": kind, "count": n}
        if kind in (SENDER, RECEIVER):
            row["ssrc"] = struct.unpack(">I", _take(body, 0, 4, "report"))[0]
            if kind == SENDER:
                row["sender"] = dict(zip(("ntp_sec", "ntp_frac", "rtp_time", "packets", "octets"), struct.unpack(">IIIII", _take(body, 4, 20, "sender")), strict=True))
            row["reports"] = _reports(body, 24 if kind == SENDER else 4, n)
        elif kind == DESCRIPTION:
            row["chunks"] = _chunks(body, n)
        elif kind == BYE:
            row["sources"] = list(struct.unpack(f">{n}I", _take(body, 0, 4 * n, "sources")))
            if len(body) > 4 * n:
                row["reason"] = _take(body, 4 * n + 1, body[4 * n], "reason").decode("utf-8", "replace")
        elif kind in (TRANSPORT, PAYLOAD):
            row["ssrc"], row["media_ssrc"] = struct.unpack(">II", _take(body, 0, 8, "feedback"))
            row["fci"] = body[8:]
            row |= _fed_back(kind, n, body[8:])
        yield row
        at, i = at + 4 + 4 * words, i + 1


def rtcp_packets(rows: DataFrame, content: str = "content") -> DataFrame:
    """One row per packet of each compound datagram; ``count`` is the packet's count or format."""
    return _scan(rows, content, FIELDS, _rtcp)


def _packet(count: Column, kind: int, body: Column) -> Column:
    filled = _padded(body)
    return F.concat(_be(0x80 + count, 1), _be(F.lit(kind), 1), _be(F.octet_length(filled) / 4, 2), filled)


def _report_bytes(reports: Column) -> Column:
    return joined_bytes(F.transform(reports, lambda r: F.concat(
        _be(r["ssrc"], 4), _be(r["fraction_lost"], 1), _be(F.pmod(r["lost"], F.lit(1 << 24)), 3), _be(r["highest"], 4), _be(r["jitter"], 4), _be(r["lsr"], 4), _be(r["delay"], 4))))


def sender_report(ssrc: Column, ntp_sec: Column, ntp_frac: Column, rtp_time: Column, packets: Column, octets: Column, reports: Column) -> Column:
    return _packet(F.size(reports), SENDER, F.concat(*[_be(x, 4) for x in (ssrc, ntp_sec, ntp_frac, rtp_time, packets, octets)], _report_bytes(reports)))


def receiver_report(ssrc: Column, reports: Column) -> Column:
    return _packet(F.size(reports), RECEIVER, F.concat(_be(ssrc, 4), _report_bytes(reports)))


def source_description(chunks: Column) -> Column:
    """Chunks of (ssrc, items of (type, text)); each ends with one to four zero bytes."""
    def chunk(c: Column) -> Column:
        items = joined_bytes(F.transform(c["items"], lambda x: F.concat(_be(x["type"], 1), _be(F.octet_length(x["text"]), 1), F.encode(x["text"], "utf-8"))))
        return _padded(F.concat(_be(c["ssrc"], 4), items, _be(F.lit(0), 1)))

    return _packet(F.size(chunks), DESCRIPTION, joined_bytes(F.transform(chunks, chunk)))


def bye(sources: Column, reason: Column) -> Column:
    """Sources that leave, with a reason unless it is null."""
    said = F.when(reason.isNotNull(), F.concat(_be(F.octet_length(reason), 1), F.encode(reason, "utf-8"))).otherwise(F.unhex(F.lit("")))
    return _packet(F.size(sources), BYE, F.concat(joined_bytes(F.transform(sources, lambda x: _be(x, 4))), said))


def feedback(kind: int, form: int, ssrc: Column, media: Column, fci: Column) -> Column:
    """A transport or payload feedback packet with its own part as bytes."""
    return _packet(F.lit(form), kind, F.concat(_be(ssrc, 4), _be(media, 4), fci))


def nack_bytes(pairs: Column, ssrc: Column, media: Column) -> Column:
    """A feedback packet of (pid, mask) pairs."""
    return feedback(TRANSPORT, NACK, ssrc, media, joined_bytes(F.transform(pairs, lambda p: F.concat(_be(p["pid"], 2), _be(p["mask"], 2)))))


def picture_loss(ssrc: Column, media: Column) -> Column:
    return feedback(PAYLOAD, PLI, ssrc, media, F.unhex(F.lit("")))


def full_intra(entries: Column, ssrc: Column) -> Column:
    """Requests of (ssrc, seq) for a full intra picture."""
    return feedback(PAYLOAD, FIR, ssrc, F.lit(0), joined_bytes(F.transform(entries, lambda x: F.concat(_be(x["ssrc"], 4), _be(x["seq"], 1), _be(F.lit(0), 3)))))


def layer_refresh(entries: Column, ssrc: Column) -> Column:
    """Requests of (ssrc, seq, target and current layers) to refresh a layer."""
    def entry(x: Column) -> Column:
        layers = [_be(x[f"{p}_temporal"] * 256 + x[f"{p}_spatial"], 2) for p in ("target", "current")]
        return F.concat(_be(x["ssrc"], 4), _be(x["seq"], 1), _be(F.lit(0), 1), *layers, _be(F.lit(0), 2))

    return feedback(PAYLOAD, LRR, ssrc, F.lit(0), joined_bytes(F.transform(entries, entry)))


def estimated_bitrate(bitrate: Column, sources: Column, ssrc: Column) -> Column:
    """A receiver's estimate: the bitrate as 18 bits and an exponent, rounded down."""
    size = F.length(F.conv(bitrate.cast("string"), 10, 2))
    exponent = F.greatest(size - 18, F.lit(0))
    mantissa = F.call_function("shiftright", bitrate.cast("long"), exponent.cast("int"))
    return feedback(PAYLOAD, AFB, ssrc, F.lit(0), F.concat(F.unhex(F.lit(b"REMB".hex())), _be(F.size(sources), 1), _be(exponent * (1 << 18) + mantissa, 3), joined_bytes(F.transform(sources, lambda x: _be(x, 4)))))


def transport_feedback(base: Column, reference: Column, number: Column, ticks: Column, ssrc: Column, media: Column) -> Column:
    """A transport feedback of the ticks of consecutive packets (null: not received), in chunks of seven statuses."""
    def status(t: Column) -> Column:
        return F.when(t.isNull(), 0).when(t.between(0, 255), 1).otherwise(2)

    def chunk(i: Column) -> Column:
        part = F.slice(ticks, i * 7 + 1, F.lit(7))
        word = F.aggregate(F.transform(part, lambda t, k: status(t) * F.element_at(F.array(*[F.lit(1 << s) for s in range(12, -1, -2)]), k + 1)), F.lit(0xC000), lambda a, b: a + b)
        return _be(word, 2)

    chunks = joined_bytes(F.transform(F.sequence(F.lit(0), F.ceil(F.size(ticks) / 7).cast("int") - 1), chunk))
    moved = F.filter(ticks, lambda t: t.isNotNull())
    deltas = joined_bytes(F.transform(moved, lambda t: F.when(t.between(0, 255), _be(t, 1)).otherwise(_be(F.pmod(t, F.lit(65536)), 2))))
    head = F.concat(_be(base, 2), _be(F.size(ticks), 2), _be(F.pmod(reference, F.lit(1 << 24)), 3), _be(number, 1))
    return feedback(TRANSPORT, TWCC, ssrc, media, F.concat(head, chunks, deltas))


def needs_key_frame(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the feedback of a group asks for a key frame: a picture loss, or a full-intra or layer-refresh request."""
    asks = ((F.col("type") == PAYLOAD) & (F.col("count") == PLI)) | (F.size("full_intra") > 0) | (F.size("refresh") > 0)
    return packets.groupBy(*keys).agg(F.bool_or(F.coalesce(asks, F.lit(False))).alias("key_frame"))


def refresh_target(packets: DataFrame, keys: list[str]) -> DataFrame:
    """The highest layers that the refresh requests of a group ask for: spatial first, then temporal."""
    entries = packets.select(*keys, F.explode("refresh").alias("r"))
    return entries.groupBy(*keys).agg(F.max(F.struct("r.target_spatial", "r.target_temporal")).alias("t")).select(*keys, "t.*")

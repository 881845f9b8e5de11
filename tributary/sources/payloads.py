"""Packet payloads that carry bitstream units: elements, fragments, packing into packets and reassembly.

A payload begins with an aggregation byte: whether its first element continues the one before (Z),
whether its last one goes on in the next packet (Y), the number of elements if at most three (W; the
last then has no length), and whether it starts a new coded sequence (N).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.sources.containers import _be, _scan, _sized, joined_bytes, leb128


def aggregation_header(first: Column) -> dict[str, Column]:
    """The bits of an aggregation byte; nulls if a reserved bit is set or N and Z are."""
    ok = (first.bitwiseAND(F.lit(7)) == 0) & (first.bitwiseAND(F.lit(0x88)) != 0x88)

    def flag(bit: int) -> Column:
        return F.when(ok, first.bitwiseAND(F.lit(bit)) != 0)

    return {"continues_previous": flag(0x80), "continues_next": flag(0x40), "elements": F.when(ok, F.shiftright(first, 4).bitwiseAND(F.lit(3))), "new_sequence": flag(8)}


def payload_bytes(elements: Column, continues_previous: Column, continues_next: Column, new_sequence: Column, counted: bool = True) -> Column:
    """A payload of elements; null if it breaks the rules.

    ``counted``: up to three elements are counted and the last has no length; otherwise all have one.
    """
    n = F.size(elements)
    w = F.when(n <= 3, n).otherwise(0) if counted else F.lit(0)
    body = F.transform(elements, lambda x, i: F.when((w > 0) & (i == n - 1), x).otherwise(_sized(x)))
    head = _be(F.when(continues_previous, 0x80).otherwise(0) + F.when(continues_next, 0x40).otherwise(0) + w * 16 + F.when(new_sequence, 8).otherwise(0), 1)
    empty = F.exists(F.transform(elements, lambda x, i: (F.octet_length(x) == 0) & ~((continues_previous & (i == 0)) | (continues_next & (i == n - 1)))), lambda x: x)
    return F.when((n > 0) & ~(new_sequence & continues_previous) & ~empty, F.concat(head, joined_bytes(body)))


def _payload(data: bytes) -> Iterator[dict]:
    if not data:
        raise ValueError("short payload")
    first, at, i = data[0], 1, 0
    if first & 7:
        raise ValueError("reserved bit is set")
    if first & 0x88 == 0x88:
        raise ValueError("a new sequence can't continue an element")
    w = first >> 4 & 3
    if len(data) == 1 and w != 1:
        raise ValueError("no elements")
    while at < len(data) or (i == 0 and w == 1):
        if w and i >= w:
            raise ValueError("more elements than counted")
        inferred = bool(w) and i == w - 1
        size = len(data) - at
        if not inferred:
            size, at = leb128(data, at)
        if at + size > len(data):
            raise ValueError("short payload")
        before, after = bool(first & 0x80) and i == 0, bool(first & 0x40) and at + size == len(data)
        if not size and not before and not after:
            raise ValueError("empty element")
        yield {"idx": i, "continues_previous": before, "continues_next": after, "inferred": inferred, "new_sequence": bool(first & 8), "data": data[at : at + size]}
        at, i = at + size, i + 1


def payload_elements(rows: DataFrame, content: str = "content") -> DataFrame:
    """One row per element of each payload."""
    return _scan(rows, content, "idx int, continues_previous boolean, continues_next boolean, inferred boolean, new_sequence boolean, data binary", _payload)


def fragmented(rows: DataFrame, data: str, mtu: int, new_sequence: Column | None = None) -> DataFrame:
    """One row per payload of at most ``mtu`` bytes of each unit: part, last and payload beside the other columns."""
    keys, room = [c for c in rows.columns if c != data], mtu - 1
    size = F.octet_length(data)
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(size / room).cast("int") - 1, F.lit(0)))
    out = rows.withColumn("part", F.explode(parts)).withColumn("last", (F.col("part") + 1) * room >= F.octet_length(data))
    piece = F.substring(F.col(data), F.col("part") * room + 1, F.lit(room))
    starts = (F.lit(False) if new_sequence is None else new_sequence) & (F.col("part") == 0)
    return out.select(*keys, "part", "last", payload_bytes(F.array(piece), F.col("part") > 0, ~F.col("last"), starts).alias("payload"))


def reassembled(packets: DataFrame, stream: str = "ssrc", seq: str = "ext_seq", content: str = "payload") -> DataFrame:
    """One row per unit of each stream: its number, first and last sequence number, fragments, new_sequence, complete and data.

    A unit is complete if its elements follow each other without a lost packet, from one that starts
    it to one that ends it; the data of others is null. Elements are numbered by a running count of
    those that start a unit, so that no stream is held as a whole.
    """
    e = payload_elements(packets.select(stream, seq, content), content).filter("error is null")
    order = Window.partitionBy(stream).orderBy(seq, "idx")
    before = F.lag(F.struct(seq, "continues_next")).over(order)
    linked = ~F.col("continues_previous") | F.coalesce(before["continues_next"] & (before[seq] == F.col(seq) - 1), F.lit(False))
    e = e.withColumn("linked", linked).withColumn("unit", F.sum(F.when(F.col("continues_previous") & F.col("linked"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("idx").alias("i"), F.col("data").alias("d"))))  # of one unit
    units = e.groupBy(stream, "unit").agg(
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("fragments"), F.bool_or("new_sequence").alias("new_sequence"),
        (~F.min_by("continues_previous", F.struct(seq, "idx")) & ~F.max_by("continues_next", F.struct(seq, "idx"))).alias("complete"), pieces.alias("pieces"))
    whole = joined_bytes(F.transform("pieces", lambda x: x["d"]))
    return units.select(stream, "unit", "first_seq", "last_seq", "fragments", "new_sequence", "complete", F.when(F.col("complete"), whole).alias("data"))


def _coded(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def _plan(sizes: list[int], limit: int, first: int, last: int) -> list[list[tuple[int, int, int]]]:
    """Packets as lists of (unit, from, to), filled in order up to ``limit`` less what the first and the last leave free.

    Every element but the last counts its length; the last packet is cut again if it overruns.
    """
    packets, now, free = [], [], limit - 1 - first
    for unit, size in enumerate(sizes):
        at = 0
        while at < size or size == 0:
            cost = _coded(now[-1][2] - now[-1][1]) if now else 0  # the element before gets a length now
            room = free - cost
            if room < 1 or len(now) == 3:
                packets.append(now)
                now, free = [], limit - 1
                continue
            take = min(size - at, room)
            now.append((unit, at, at + take))
            free, at = room - take, at + take
            if size == 0:
                break
    packets.append(now)
    if last and packets[-1] and free < last:
        unit, a, b = packets[-1][-1]
        cut = max(a, b - (last - free))
        if a < cut < b:
            packets[-1][-1] = (unit, a, cut)
            packets.append([(unit, cut, b)])
        elif len(packets[-1]) > 1:
            packets.append([packets[-1].pop()])
    return packets


def packed(pictures: DataFrame, units: str, limit: int, first: int = 0, last: int = 0, key_frame: str | None = None) -> DataFrame:
    """One row per packet of each picture: packet, payload and marker, from the picture's units in order.

    Packets are filled up to ``limit`` bytes, of which the first and the last leave some free; then a
    smaller limit that needs no more packets evens them out, if more than ten bytes a packet are
    unused. The marker is on the last packet of a picture; a key frame starts a new sequence.
    """
    keys = [c for c in pictures.columns if c != units]
    schema = pictures.select(*keys, F.lit(0).alias("packet"), F.lit(b"").alias("payload"), F.lit(False).alias("marker")).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def bytes_of(parts: list[tuple[int, int, int]], data: list[bytes], fresh: bool) -> bytes:
        out = bytearray([(parts[0][1] > 0) << 7 | (parts[-1][2] < len(data[parts[-1][0]])) << 6 | len(parts) << 4 | fresh << 3])
        for k, (unit, a, b) in enumerate(parts):
            if k < len(parts) - 1:
                n = b - a
                while n > 127:
                    out.append(n & 127 | 128)
                    n >>= 7
                out.append(n)
            out += data[unit][a:b]
        return bytes(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = [x for x in batch.column(len(keys))[r].as_py() or [] if x]
                if not data:
                    continue
                sizes = [len(x) for x in data]
                plan = _plan(sizes, limit, first, last)
                used = sum(b - a for p in plan for _, a, b in p)
                if len(plan) > 1 and len(plan) * (limit - 1) - used > 10 * len(plan):
                    low, high = max(first, last) + 8, limit
                    while low < high:
                        middle = (low + high) // 2
                        low, high = (low, middle) if len(_plan(sizes, middle, first, last)) <= len(plan) else (middle + 1, high)
                    plan = _plan(sizes, high, first, last)
                fresh = bool(batch.column(keys.index(key_frame))[r].as_py()) if key_frame else False
                whole = [pa.array([batch.column(i)[r].as_py()] * len(plan), arrow.field(i).type) for i in range(len(keys))]
                out = [bytes_of(p, data, fresh and k == 0) for k, p in enumerate(plan)]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(range(len(plan)), pa.int32()), pa.array(out, pa.binary()), pa.array([k == len(plan) - 1 for k in range(len(plan))])], schema=arrow)

    return pictures.select(*keys, units).mapInArrow(run, schema)


# --- header extensions -----------------------------------------------------------------------------

#: Fields of header extensions with their widths in bits, first field first.
EXTENSIONS = {
    "playout_delay": (("minimum", 12), ("maximum", 12)),
    "absolute_send_time": (("seconds", 6), ("fraction", 18)),
    "transport_sequence": (("seq", 16),),
    "transport_sequence_2": (("seq", 16), ("timed", 1), ("count", 15)),
    "video_orientation": (("reserved", 4), ("camera", 1), ("flip", 1), ("rotation", 2)),
    "video_content": (("kind", 8),),
    "audio_level": (("voice", 1), ("level", 7)),
    "video_timing": (("flags", 8), ("encode_start", 16), ("encode_finish", 16), ("packetized", 16), ("pacer_exit", 16), ("network", 16), ("network_2", 16)),
    "capture_time": (("seconds", 32), ("fraction", 32)),
}


def extension_bytes(kind: str, values: dict[str, Column]) -> Column:
    """The payload of a header extension; null if a value doesn't fit its field."""
    text, fits = [], F.lit(True)
    for name, bits in EXTENSIONS[kind]:
        value = values.get(name, F.lit(0)).cast("long")
        text.append(F.lpad(F.bin(value), bits, "0"))
        fits &= value.between(0, (1 << bits) - 1)
    size = sum(bits for _, bits in EXTENSIONS[kind]) // 4
    whole = F.concat(*text)
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(whole, i * 4 + 1, F.lit(4)), 2, 16)), "")
    return F.when(fits, F.unhex(digits))


def extension_values(kind: str, payload: Column) -> dict[str, Column]:
    """The fields of a header extension; nulls for a payload of another length."""
    size, at, out = sum(bits for _, bits in EXTENSIONS[kind]) // 8, 0, {}
    digits = F.hex(payload)
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size * 2 - 1)), lambda i: F.lpad(F.conv(F.substring(digits, i + 1, F.lit(1)), 16, 2), 4, "0")), "")
    for name, bits in EXTENSIONS[kind]:
        out[name] = F.when(F.octet_length(payload) == size, F.conv(F.substring(whole, at + 1, bits), 2, 10).cast("long"))
        at += bits
    return out


# --- templates that persist ------------------------------------------------------------------------


def current_structure(packets: DataFrame, stream: str, seq: str, structure: str) -> DataFrame:
    """Each packet with the template structure that holds for it: its own, or the last one before; null until one was seen."""
    order = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return packets.withColumn("current", F.last(F.col(structure), ignorenulls=True).over(order))

"""Readers of binary containers and packets, and the bytes they are written as.

A reader takes a DataFrame with a binary column and gives one row per frame, unit or packet. Parsing
is per row of bytes, in Arrow batches; a row that is malformed yields the part before the fault and
one row with ``error`` set, so that faults are data. Writers are column expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tributary.functions.columns import leb128_bytes, let


#: Bytes that are parsed before their rows are handed on, about.
SCANNED = 4 << 20


def _scan(df: DataFrame, data: str, fields: str, parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Rows of ``parse`` for each row, with the other columns of the row beside them."""
    keys = [c for c in df.columns if c != data]
    parsed = T.StructType.fromDDL(fields + ", error string")
    schema = T.StructType([*df.select(*keys).schema.fields, *parsed.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in parsed.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []

            def found(batch: pa.RecordBatch = batch, rows: list = rows, of: list = of) -> pa.RecordBatch:
                columns = [batch.column(i).take(pa.array(of, pa.int32())) for i in range(len(keys))]
                columns += [pa.array([r.get(n) for r in rows], arrow.field(len(keys) + i).type) for i, n in enumerate(names)]
                rows.clear()
                of.clear()
                return pa.RecordBatch.from_arrays(columns, schema=arrow)

            held = 0
            for k, value in enumerate(batch.column(len(keys))):
                value, before = value.as_py(), len(rows)
                try:
                    for row in parse(value) if value is not None else ():
                        rows.append(row)
                except (ValueError, IndexError, struct.error) as e:
                    rows.append({"error": str(e) or type(e).__name__})
                of += [k] * (len(rows) - before)
                held += len(value or b"")
                if held > SCANNED or len(rows) > 4096:
                    yield found()
                    held = 0
            if rows:
                yield found()

    return df.select(*keys, data).mapInArrow(run, schema)


def _take(data: bytes, at: int, n: int, what: str) -> bytes:
    if n < 0 or at + n > len(data):
        raise ValueError(f"truncated {what}")
    return data[at : at + n]


def leb128(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place) of a variable-length integer of at most eight bytes and 32 bits."""
    value = 0
    for i in range(8):
        byte = _take(data, at + i, 1, "size")[0]
        value |= (byte & 127) << (7 * i)
        if byte < 128:
            if value >> 32:
                raise ValueError("size beyond 32 bits")
            return value, at + i + 1
    raise ValueError("size of more than eight bytes")


# --- frames in an IVF file -------------------------------------------------------------------------


def _ivf(data: bytes) -> Iterator[dict]:
    head = _take(data, 0, 32, "file header")
    mark, _, length, codec, width, height, den, num, count, _ = struct.unpack("<4sHH4sHHIIII", head)
    if mark != b"DKIF" or codec != b"AV01" or length != 32:
        raise ValueError("not an IVF file of this codec")
    at, i = 32, 0
    while at < len(data):
        size, pts = struct.unpack("<IQ", _take(data, at, 12, "frame header"))
        yield {"width": width, "height": height, "timebase_den": den, "timebase_num": num, "frame_count": count, "idx": i, "offset": at + 12, "pts": pts, "payload": _take(data, at + 12, size, "frame")}
        at, i = at + 12 + size, i + 1


def ivf_frames(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per frame of each file."""
    return _scan(files, content, "width int, height int, timebase_den long, timebase_num long, frame_count long, idx int, offset long, pts long, payload binary", _ivf)


def read_ivf(spark, path: str) -> DataFrame:
    """The frames of the files under ``path``."""
    return ivf_frames(spark.read.format("binaryFile").load(path).select("path", "content"))


def _le(value: Column, n: int) -> Column:
    """An integer as ``n`` bytes, low byte first."""
    big = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(big, 2 * (n - i) - 1, 2) for i in range(n)]))


def _be(value: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def ivf_file(frames: DataFrame, keys: list[str], width: int, height: int, den: int, num: int) -> DataFrame:
    """Each group's frames (idx, pts, payload) as the bytes of one file; large groups are cut by :func:`segmented` first."""
    record = F.concat(_le(F.octet_length("payload"), 4), _le(F.col("pts"), 8), F.col("payload"))
    grouped = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", record.alias("bytes")))).alias("f"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.unhex(F.lit(b"DKIF".hex())), _le(F.lit(0), 2), _le(F.lit(32), 2), F.unhex(F.lit(b"AV01".hex())), _le(F.lit(width), 2), _le(F.lit(height), 2), _le(F.lit(den), 4), _le(F.lit(num), 4), _le(F.col("n"), 4), _le(F.lit(0), 4))
    body = F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["bytes"])), ""))
    return grouped.select(*keys, F.concat(head, body).alias("content"))


# --- units of a bitstream --------------------------------------------------------------------------


def _unit(data: bytes, at: int, end: int) -> tuple[dict, int]:
    first = _take(data[:end], at, 1, "unit header")[0]
    if first & 128:
        raise ValueError("forbidden bit is set")
    kind, extension, sized, at = first >> 3 & 15, first >> 2 & 1, first >> 1 & 1, at + 1
    t = s = 0
    if extension:
        byte = _take(data[:end], at, 1, "unit extension")[0]
        t, s, at = byte >> 5, byte >> 3 & 3, at + 1
    size = end - at
    if sized:
        size, at = leb128(data[:end], at)
    return {"type": kind, "temporal_id": t, "spatial_id": s, "has_size": bool(sized), "payload": _take(data[:end], at, size, "unit")}, at + size


def _units(data: bytes) -> Iterator[dict]:
    at, i, tu = 0, 0, -1
    while at < len(data):
        start = at
        row, at = _unit(data, at, len(data))
        if not row["has_size"]:
            raise ValueError("unit without a size in a low-overhead stream")
        tu += row["type"] == 2
        yield row | {"idx": i, "offset": start, "temporal_unit": max(tu, 0)}
        i += 1


_UNIT = "idx int, offset long, temporal_unit int, type int, temporal_id int, spatial_id int, has_size boolean, payload binary"


def low_overhead_units(rows: DataFrame, content: str = "content") -> DataFrame:
    """One row per unit of a low-overhead stream; a temporal delimiter (type 2) starts a temporal unit."""
    return _scan(rows, content, _UNIT, _units)


def _annexb(data: bytes) -> Iterator[dict]:
    at, i, tu = 0, 0, 0
    while at < len(data):
        size, at = leb128(data, at)
        stop_tu = at + len(_take(data, at, size, "temporal unit"))
        frame = 0
        while at < stop_tu:
            size, at = leb128(data, at)
            if at + size > stop_tu:
                raise ValueError("frame unit beyond its temporal unit")
            stop = at + size
            while at < stop:
                size, at = leb128(data, at)
                if at + size > stop:
                    raise ValueError("unit beyond its frame unit")
                row, _ = _unit(data, at, at + size)
                yield row | {"idx": i, "offset": at, "temporal_unit": tu, "frame_unit": frame}
                at, i = at + size, i + 1
            frame += 1
        tu += 1


def annexb_units(rows: DataFrame, content: str = "content") -> DataFrame:
    """One row per unit of a length-delimited stream, with its temporal and frame unit."""
    return _scan(rows, content, _UNIT.replace("type int", "frame_unit int, type int"), _annexb)


def resized(raw: Column) -> Column:
    """A unit's bytes with a size field: as they are if they have one, else with the flag set and the size put in.

    Null for fewer bytes than the header has.
    """
    first = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")
    head = F.when(first.bitwiseAND(F.lit(4)) != 0, 2).otherwise(1)
    flagged = F.concat(_be(first.bitwiseOR(F.lit(2)), 1), F.substring(raw, F.lit(2), head - 1))
    made = F.when(first.bitwiseAND(F.lit(2)) != 0, raw).otherwise(F.concat(flagged, _sized(F.substring(raw, head + 1, F.lit(1 << 30)))))
    return F.when(F.octet_length(raw) >= head, made)


def _sized(bytes_: Column) -> Column:
    """Bytes behind their length as a variable-length integer."""

    def behind(b: Column) -> Column:
        groups = let(F.octet_length(b).cast("long"), lambda n: F.transform(leb128_bytes(n), lambda x: F.lpad(F.hex(x), 2, "0")))
        return F.concat(F.unhex(F.array_join(groups, "")), b)

    return let(bytes_, behind)


def unit_bytes(kind: Column, temporal: Column, spatial: Column, payload: Column, sized: bool = True) -> Column:
    """A unit with its two header bytes."""
    head = F.concat(_be(kind * 8 + 4 + (2 if sized else 0), 1), _be(temporal * 32 + spatial * 8, 1))
    return F.concat(head, _sized(payload) if sized else payload)


def segmented(rows: DataFrame, keys: list[str], order: str, size: Column, limit: int) -> DataFrame:
    """Rows with ``place`` (from 0) and ``segment`` in their group, and ``first``, the segment's first place.

    A segment holds rows of about ``limit`` bytes, so that what is written from one is bounded
    however large the group is; segments follow each other.
    """
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).withColumn("segment", F.floor((F.sum(size).over(ahead) - size) / limit))
    return out.withColumn("first", F.min("place").over(Window.partitionBy(*keys, "segment")))


def segmented_units(rows: DataFrame, keys: list[str], temporal: str, size: Column, limit: int) -> DataFrame:
    """As :func:`segmented`, but cut between temporal units, whose numbers are in ``temporal``.

    ``first`` is the number of the segment's first row in its group, ``first_unit`` that of its first temporal unit.
    """
    per = rows.groupBy(*keys, temporal).agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    ahead = Window.partitionBy(*keys).orderBy(temporal)  # a row for each temporal unit
    cut = per.withColumn("segment", F.floor((F.sum("_bytes").over(ahead) - F.col("_bytes")) / limit)).withColumn("_before", F.sum("_rows").over(ahead) - F.col("_rows"))
    within = Window.partitionBy(*keys, "segment")
    placed = cut.select(*keys, temporal, "segment", F.min("_before").over(within).cast("int").alias("first"), F.min(temporal).over(within).cast("int").alias("first_unit"))
    return rows.join(placed, [*keys, temporal])


def low_overhead_stream(units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each group's units (type, t, s, payload) as one low-overhead stream; large groups are cut by :func:`segmented` first."""
    record = unit_bytes(F.col("type"), F.col("t"), F.col("s"), F.col("payload"))
    listed = F.array_sort(F.collect_list(F.struct(order, record.alias("b"))))
    return units.groupBy(*keys).agg(joined_bytes(F.transform(listed, lambda x: x["b"])).alias("content"))


def annexb_stream(units: DataFrame, keys: list[str], order: str, temporal: str | None = None) -> DataFrame:
    """Each group's units as temporal units of one frame unit, length by length: one for each value of ``temporal``, or one in all."""
    record = _sized(unit_bytes(F.col("type"), F.col("t"), F.col("s"), F.col("payload"), sized=False))
    rows = units.withColumn("_unit", F.col(temporal) if temporal else F.lit(0))
    listed = F.array_sort(F.collect_list(F.struct(order, record.alias("b"))))
    frames = rows.groupBy(*keys, "_unit").agg(_sized(_sized(joined_bytes(F.transform(listed, lambda x: x["b"])))).alias("b"))
    return frames.groupBy(*keys).agg(joined_bytes(F.transform(F.array_sort(F.collect_list(F.struct("_unit", "b"))), lambda x: x["b"])).alias("content"))


def annexb_as_low_overhead(rows: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Length-delimited streams as low-overhead ones."""
    units = annexb_units(rows.select(*keys, content), content).filter("error is null")
    return low_overhead_stream(units.withColumnRenamed("temporal_id", "t").withColumnRenamed("spatial_id", "s"), keys, "idx")


# --- packets ---------------------------------------------------------------------------------------


def _elements(profile: int, body: bytes) -> list[dict]:
    out, at = [], 0
    short = profile == 0xBEDE
    while at < len(body):
        if body[at] == 0:
            at += 1
            continue
        if short:
            number, size, at = body[at] >> 4, (body[at] & 15) + 1, at + 1
            if number == 15:
                break
        else:
            number, size, at = body[at], _take(body, at + 1, 1, "extension")[0], at + 2
        out.append({"id": number, "payload": _take(body, at, size, "extension")})
        at += size
    return out


def _rtp(data: bytes) -> Iterator[dict]:
    first, second, seq, ts, ssrc = struct.unpack(">BBHII", _take(data, 0, 12, "packet header"))
    if first >> 6 != 2:
        raise ValueError("not version 2")
    n = first & 15
    sources = list(struct.unpack(f">{n}I", _take(data, 12, 4 * n, "sources")))
    at, profile, elements = 12 + 4 * n, None, []
    if first >> 4 & 1:
        profile, words = struct.unpack(">HH", _take(data, at, 4, "extension header"))
        body = _take(data, at + 4, 4 * words, "extension")
        at += 4 + 4 * words
        if profile == 0xBEDE or profile >> 4 == 0x100:
            elements = _elements(profile, body)
    end = len(data)
    if first >> 5 & 1:
        if data[-1] == 0 or end - data[-1] < at:
            raise ValueError("padding beyond the payload")
        end -= data[-1]
    yield {"marker": bool(second >> 7), "payload_type": second & 127, "seq": seq, "timestamp": ts, "ssrc": ssrc, "csrc": sources, "profile": profile, "extensions": elements, "payload": data[at:end]}


def rtp_packets(rows: DataFrame, content: str = "content") -> DataFrame:
    """The header, extensions and payload of each packet."""
    return _scan(rows, content, "marker boolean, payload_type int, seq int, timestamp long, ssrc long, csrc array<long>, profile int, extensions array<struct<id:int,payload:binary>>, payload binary", _rtp)


def extension(elements: Column, profile: Column, number: Column | int) -> Column:
    """The payload of the element with an id; null if there is none, or if the id can't be one of the profile."""
    number = number if isinstance(number, Column) else F.lit(number)
    found = F.get(F.filter(elements, lambda x: x["id"] == number), 0)["payload"]
    return F.when((number > 0) & ((profile != 0xBEDE) | (number < 15)), found)


def joined_bytes(parts: Column) -> Column:
    """The bytes of a short array of binaries, one behind the other."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def _padded(bytes_: Column, step: int = 4) -> Column:
    """Bytes filled up with zeros to a multiple of ``step``."""
    return F.concat(bytes_, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.octet_length(bytes_), F.lit(step)))))


def rtp_packet_bytes(marker: Column, payload_type: Column, seq: Column, timestamp: Column, ssrc: Column, payload: Column, csrc: Column, extensions: Column, padding: Column) -> Column:
    """A packet with sources, one-byte-header extension elements (id, payload) and padding; 0 bytes of padding are none."""
    body = _padded(joined_bytes(F.transform(extensions, lambda x: F.concat(_be(x["id"] * 16 + F.octet_length(x["payload"]) - 1, 1), x["payload"]))))
    extended = F.size(extensions) > 0
    first = 0x80 + F.when(padding > 0, 0x20).otherwise(0) + F.when(extended, 0x10).otherwise(0) + F.size(csrc)
    head = F.concat(_be(first, 1), _be(F.when(marker, 128).otherwise(0) + payload_type, 1), _be(seq, 2), _be(timestamp, 4), _be(ssrc, 4), joined_bytes(F.transform(csrc, lambda x: _be(x, 4))))
    middle = F.when(extended, F.concat(_be(F.lit(0xBEDE), 2), _be(F.octet_length(body) / 4, 2), body)).otherwise(F.unhex(F.lit("")))
    last = F.when(padding > 0, F.concat(F.unhex(F.repeat(F.lit("00"), (padding - 1).cast("int"))), _be(padding, 1))).otherwise(F.unhex(F.lit("")))
    return F.concat(head, middle, payload, last)


def rtx_bytes(payload_type: Column, seq: Column, timestamp: Column, ssrc: Column, original_seq: Column, payload: Column, marker: Column) -> Column:
    """A packet sent again: a stream of its own, with the original sequence number before the payload."""
    return rtp_bytes(marker, payload_type, seq, timestamp, ssrc, F.concat(_be(original_seq, 2), payload))


def rtx_original(payload: Column) -> tuple[Column, Column]:
    """(original sequence number, original payload) of a packet sent again; nulls for a payload of less than two bytes."""
    whole = F.octet_length(payload) >= 2
    return F.when(whole, F.conv(F.hex(F.substring(payload, 1, 2)), 16, 10).cast("int")), F.when(whole, F.substring(payload, 3, 1 << 30))


def rtp_bytes(marker: Column, payload_type: Column, seq: Column, timestamp: Column, ssrc: Column, payload: Column) -> Column:
    """A packet without sources or extensions."""
    return F.concat(_be(F.lit(0x80), 1), _be(F.when(marker, 128).otherwise(0) + payload_type, 1), _be(seq, 2), _be(timestamp, 4), _be(ssrc, 4), payload)

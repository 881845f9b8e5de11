"""Dependency descriptors with templates that persist over a stream, and layer allocations.

A descriptor names a template of the structure that was sent last, so what a packet means depends on
packets before it. Structures are read on their own first; each packet then gets the last valid one before it by a filling
in two steps (within pieces of a stream, then between pieces), and is decoded with it. A stream is therefore never held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tributary.functions.columns import leb128_bytes, let
from tributary.sources import bits as W
from tributary.sources.bits import Bits
from tributary.sources.containers import _scan, leb128

# The most layers, templates and differences that a descriptor can have.
SPATIAL, TEMPORAL, TEMPLATES, DIFFERENCES = 4, 8, 64, 32
#: Sequence numbers of a piece of a stream.
PIECE = 1 << 12


def _layers(b: Bits) -> list[tuple[int, int]]:
    """(spatial, temporal) of each template: the same as the one before, the next temporal or the next spatial layer."""
    out = [(0, 0)]
    while True:
        step = b.take(2)
        if step == 3:
            return out
        spatial, temporal = out[-1]
        spatial, temporal = [(spatial, temporal), (spatial, temporal + 1), (spatial + 1, 0)][step]
        if spatial >= SPATIAL or temporal >= TEMPORAL or len(out) >= TEMPLATES:
            raise ValueError("too many layers or templates")
        out.append((spatial, temporal))


def _differences(b: Bits) -> list[int]:
    out = []
    while b.flag():
        if len(out) >= DIFFERENCES:
            raise ValueError("too many frame differences")
        out.append(b.take(4) + 1)
    return out


def _structure(b: Bits) -> dict:
    first, targets = b.take(6), b.take(5) + 1
    layers = _layers(b)
    indications = [b.many(targets, 2) for _ in layers]
    differences = [_differences(b) for _ in layers]
    chains = b.among(targets + 1)
    protected = [b.among(chains) for _ in range(targets)] if chains else []
    chain = [b.many(chains, 4) for _ in layers]
    sizes = [(b.take(16) + 1, b.take(16) + 1) for _ in range(layers[-1][0] + 1)] if b.flag() else []
    if any(w > 65535 or h > 65535 for w, h in sizes):
        raise ValueError("resolution beyond 16 bits")
    return {"first": first, "targets": targets, "layers": layers, "indications": indications, "differences": differences, "chains": chains, "protected": protected, "chain": chain, "sizes": sizes}


_OWN_STRUCTURE = object()


def decode(data: bytes, known: dict | None | object = _OWN_STRUCTURE) -> dict:
    """The fields of a descriptor, whose template is one of its own structure or else of ``known``."""
    if len(data) < 3:
        raise ValueError("short payload")
    b = Bits(data)
    out = {"first_packet": b.flag(), "last_packet": b.flag(), "template": b.take(6), "frame": b.take(16), "attached": False}
    custom = [False] * 3
    structure = known
    if len(data) > 3:
        out["attached"], masked, *custom = (b.flag() for _ in range(5))
        if out["attached"]:
            structure = out["structure"] = _structure(b)
            out["mask"] = (1 << structure["targets"]) - 1
        if not structure or structure is _OWN_STRUCTURE:
            raise ValueError("no structure")
        if masked:
            out["mask"] = b.take(structure["targets"])
    if not structure or structure is _OWN_STRUCTURE:
        raise ValueError("no structure")
    k = (out["template"] - structure["first"]) % TEMPLATES
    if k >= len(structure["layers"]):
        raise ValueError("no such template")
    out["spatial_id"], out["temporal_id"] = structure["layers"][k]
    out["indications"] = b.many(structure["targets"], 2) if custom[0] else structure["indications"][k]
    out["differences"] = list(_sized_differences(b)) if custom[1] else structure["differences"][k]
    out["chains"] = b.many(structure["chains"], 8) if custom[2] else structure["chain"][k]
    if structure["sizes"]:
        out["width"], out["height"] = structure["sizes"][out["spatial_id"]]
    out["protected_by"] = structure["protected"]
    out["consumed"] = -(-b.at // 8)
    return out


def _sized_differences(b: Bits) -> Iterator[int]:
    """Frame differences behind the number of their four-bit groups, up to a zero."""
    n = 0
    while size := b.take(2):
        if n >= DIFFERENCES:
            raise ValueError("too many frame differences")
        n += 1
        yield (b.take(4 * size) + 1) & 0xFFFF


FIELDS = (
    "first_packet boolean, last_packet boolean, template int, frame int, attached boolean, mask long, spatial_id int, temporal_id int, indications array<int>, differences array<int>, chains array<int>, "
    "protected_by array<int>, width int, height int, consumed int"
)


def filled(rows: DataFrame, stream: str, order: str, values: list[str], piece: int = PIECE) -> DataFrame:
    """Each row of a stream with the last value, not null, of some columns up to it, as ``last_<name>``.

    ``order`` is a whole number. It cuts a stream into pieces, which are filled on their own and then from the pieces
    before them, so a stream of any length is dealt to many tasks.
    """
    keyed = rows.withColumn("_piece", F.floor(F.col(order) / piece))
    within = Window.partitionBy(stream, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = keyed.groupBy(stream, "_piece").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_end_{v}") for v in values])
    before = Window.partitionBy(stream).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    begun = ends.select(F.col(stream).alias("_stream"), F.col("_piece").alias("_at"), *[F.last(f"_end_{v}", ignorenulls=True).over(before).alias(f"_begun_{v}") for v in values])
    here = keyed.select("*", *[F.last(v, ignorenulls=True).over(within).alias(f"_here_{v}") for v in values])
    out = here.join(begun, here[stream].eqNullSafe(begun["_stream"]) & here["_piece"].eqNullSafe(begun["_at"]), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_here_{v}", f"_begun_{v}").alias(f"last_{v}") for v in values])


def dependency_descriptors(packets: DataFrame, stream: str = "ssrc", order: str = "ext_seq", content: str = "descriptor", piece: int = PIECE) -> DataFrame:
    """Descriptors of the packets of each stream, decoded with the structure that holds for each; one row a row.

    Beside the other columns: the fields of the descriptor, ``mask`` (decode targets that it makes active), ``active``
    (those active by now, from it or one before), and ``error``. A descriptor with a fault changes nothing for those after
    it. A null descriptor has no fields and no error.
    """
    known = F.when(F.col("_own").isNotNull(), F.col(content))
    sent = packets.withColumn("_own", _attached(F.col(content)))
    rows = filled(sent.withColumn("_structure", known), stream, order, ["_structure"], piece).drop("_own", "_structure")
    names = [c for c in rows.columns if c != "last__structure"]
    parsed = T.StructType.fromDDL(FIELDS + ", error string")
    schema = T.StructType([*rows.select(names).schema.fields, *parsed.fields])
    arrow = to_arrow_schema(schema)
    place = names.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=4096)
        def structure(data: bytes) -> dict:
            return decode(data)["structure"]

        for batch in batches:
            out = []
            for data, holder in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                try:
                    out.append({} if data is None else decode(data, structure(holder) if holder is not None else None))
                except ValueError as e:
                    out.append({"error": str(e)})
            columns = [batch.column(k) for k in range(len(names))] + [pa.array([r.get(f.name) for r in out], arrow.field(len(names) + k).type) for k, f in enumerate(parsed.fields)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    decoded = rows.select(*names, "last__structure").mapInArrow(run, schema)
    return filled(decoded, stream, order, ["mask"], piece).withColumnRenamed("last_mask", "active")


def _attached(descriptor: Column) -> Column:
    """True for a sound descriptor with a structure of its own, else null."""

    def own(data: bytes | None) -> bool | None:
        try:
            return True if data is not None and len(data) > 3 and data[3] & 0x80 and decode(data) else None
        except ValueError:
            return None

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([own(x) for x in column], dtype=object)

    return F.pandas_udf(run, T.BooleanType())(descriptor)


# --- layer allocations -----------------------------------------------------------------------------

_LAYER = "struct<stream:int,spatial_id:int,kbps:array<long>,width:int,height:int,framerate:int>"
ALLOCATION = f"stream int, streams int, sized boolean, layers array<{_LAYER}>"


def allocation(data: bytes) -> dict:
    """The fields of a layers allocation; a single zero byte is one of no active layers."""
    if not data:
        raise ValueError("short payload")
    if data == b"\0":
        return {"stream": 0, "streams": 1, "sized": False, "layers": []}
    b = Bits(data)
    stream, streams, shared = b.take(2), b.take(2) + 1, b.take(4)
    if stream >= streams:
        raise ValueError("no such stream")
    masks = [shared] * streams
    if not shared:
        masks = b.many(streams + streams % 2, 4)[:streams]
    layers = [{"stream": s, "spatial_id": k} for s, mask in enumerate(masks) for k in range(SPATIAL) if mask >> k & 1]
    if not layers:
        raise ValueError("no layers")
    counts = [n + 1 for n in b.many(-(-len(layers) // 4) * 4, 2)]
    at = b.at // 8
    for layer, n in zip(layers, counts, strict=False):
        layer["kbps"] = []
        for _ in range(n):
            rate, at = leb128(data, at)
            layer["kbps"].append(rate)
    left = len(data) - at
    if left and left != 5 * len(layers):
        raise ValueError("truncated resolutions" if left < 5 * len(layers) else "bytes behind the resolutions")
    if left:
        b = Bits(data, 8 * at)
        for layer in layers:
            layer |= {"width": b.take(16) + 1, "height": b.take(16) + 1, "framerate": b.take(8)}
    return {"stream": stream, "streams": streams, "sized": bool(left), "layers": layers}


def layer_allocations(rows: DataFrame, content: str = "content") -> DataFrame:
    """The streams and active layers of each allocation, with their bitrates and, if ``sized``, sizes and frame rates."""

    def parse(data: bytes) -> Iterator[dict]:
        yield allocation(data)

    return _scan(rows, content, ALLOCATION, parse)


def allocation_bytes(stream: Column, streams: Column, layers: Column, sized: Column) -> Column:
    """An allocation of layers (stream, spatial_id, kbps, width, height, framerate), in any order; null if it breaks the rules.

    Layers are written by stream and spatial layer; a mask that all streams share is written once. Without
    layers there may be one stream at most, the first, and no sizes.
    """
    ordered = F.array_sort(F.transform(layers, lambda x: F.struct(x["stream"].alias("stream"), x["spatial_id"].alias("spatial_id"), x["kbps"].alias("kbps"), x["width"].alias("width"), x["height"].alias("height"), x["framerate"].alias("framerate"))))

    def bits_of(x: Column) -> Column:
        """The layers' digits behind the masks: temporal layers, bitrates, sizes."""
        counts = W.joined(F.transform(x, lambda r: W.field(F.size(r["kbps"]) - 1, 2)))
        filled_counts = F.concat(counts, F.repeat(F.lit("0"), F.pmod(-2 * F.size(x), F.lit(8))))
        rates = W.joined(F.transform(F.flatten(F.transform(x, lambda r: r["kbps"])), lambda r: W.joined(F.transform(leb128_bytes(r.cast("long")), lambda v: W.field(v, 8)))))
        sizes = F.when(sized, W.joined(F.transform(x, lambda r: F.concat(W.field(r["width"] - 1, 16), W.field(r["height"] - 1, 16), W.field(r["framerate"], 8))))).otherwise("")
        return F.concat(filled_counts, rates, sizes)

    def masked(each: Column) -> Column:
        used = F.slice(each, F.lit(1), streams.cast("int"))
        shared = F.when(F.array_min(used) == F.array_max(used), F.get(used, F.lit(0))).otherwise(0)
        listed = W.joined(F.transform(F.slice(each, F.lit(1), (streams + streams % 2).cast("int")), lambda m: W.field(m, 4)))
        return let(shared, lambda m: F.concat(W.field(m, 4), F.when(m == 0, listed).otherwise("")))

    masks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.aggregate(F.filter(layers, lambda x: x["stream"] == s), F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["spatial_id"].cast("int")))))
    n = F.size(layers)
    digits = F.concat(W.field(stream, 2), W.field(streams - 1, 2), let(masks, masked), let(ordered, bits_of))
    sound = F.forall(layers, lambda x: x["stream"].between(0, 3) & (x["stream"] < streams) & x["spatial_id"].between(0, 3) & F.size(x["kbps"]).between(1, 4) & F.forall(x["kbps"], lambda r: r.between(0, (1 << 32) - 1))
                     & F.when(sized, x["width"].between(1, 65536) & x["height"].between(1, 65536) & x["framerate"].between(0, 255)).otherwise(F.coalesce(x["width"], x["height"], x["framerate"]).isNull()))
    distinct = F.size(F.array_distinct(F.transform(layers, lambda x: x["stream"] * 4 + x["spatial_id"]))) == n
    whole = F.when(sound & distinct & streams.between(1, 4) & (stream >= 0) & (stream < streams), W.packed(digits))
    return F.when(n == 0, F.when((stream == 0) & streams.between(0, 1) & ~sized, F.unhex(F.lit("00")))).otherwise(whole)

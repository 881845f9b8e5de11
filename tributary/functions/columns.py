"""Column functions for packed headers, modular sequence numbers and integer signal arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(value: Column, place: Column | int) -> Column:
    """Bit ``place`` of an integer, as 0 or 1."""
    return F.call_function("shiftright", value, place if isinstance(place, Column) else F.lit(place)).bitwiseAND(F.lit(1))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def seq_distance(seq: Column, base: Column) -> Column:
    """Signed distance of 16-bit sequence numbers: how far ``seq`` is ahead of ``base``."""
    return F.pmod(seq - base + 32768, F.lit(65536)) - 32768


def order_hint_distance(a: Column, b: Column, bits: int) -> Column:
    """Signed distance of order hints of ``bits`` bits."""
    half = 1 << (bits - 1)
    return F.pmod(a - b + half, F.lit(1 << bits)) - half


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def leb128_length(value: Column) -> Column:
    """Bytes of the shortest variable-length coding of a value below 2^35; null for negative ones."""
    out = F.when(value < 0, F.lit(None).cast("int"))
    for n in range(1, 6):
        out = out.when(value < (1 << (7 * n)), n)
    return out


def leb128_bytes(value: Column) -> Column:
    """The coded bytes as integers, low groups first, each but the last with its top bit set."""
    n = leb128_length(value)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftright", value, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < n - 1, 128).otherwise(0))


def leb128_value(groups: Column) -> Column:
    """The value of coded bytes."""
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("s"))
    return F.aggregate(groups, start, lambda a, b: F.struct((a["v"] + F.call_function("shiftleft", b.cast("long").bitwiseAND(F.lit(127)), a["s"])).alias("v"), (a["s"] + 7).alias("s")), lambda a: a["v"])


def operating_point_matches(idc: Column, temporal: Column, spatial: Column) -> Column:
    """Whether an operating point holds a layer; the empty one holds all."""
    return (idc == 0) | ((bit(idc, temporal.cast("int")) == 1) & (bit(idc, (spatial + 8).cast("int")) == 1))


def temporal_id(layers: int, index: Column) -> Column:
    """Temporal layer of the index-th picture after a key: trailing zeros, counted from the top layer; null for 0."""
    zeros = F.bit_count(index.bitwiseAND(-index) - 1)
    return F.when(index > 0, layers - 1 - F.least(zeros, F.lit(layers - 1)))


def cdef_strength(packed: Column) -> tuple[Column, Column]:
    """(primary, secondary) of a packed strength; a secondary of 3 stands for 4."""
    secondary = packed.bitwiseAND(F.lit(3))
    return F.shiftright(packed, 2), F.when(secondary == 3, 4).otherwise(secondary)


def lower_mv_precision(component: Column, whole: bool = False) -> Column:
    """A motion-vector component with odd values moved one step towards zero, or rounded to whole samples."""
    if whole:
        size = F.abs(component)
        rounded = F.shiftleft(F.shiftright(size + 3, 3), 3)
        return F.when(component < 0, -rounded).otherwise(rounded)
    return F.when(component % 2 == 0, component).when(component > 0, component - 1).otherwise(component + 1)


def scale_factor_q14(reference: Column, current: Column) -> Column:
    """Size ratio in 14-bit fixed point, rounded; null beyond twice down or sixteen times up."""
    ok = (current * 2 >= reference) & (current <= reference * 16) & (current > 0)
    return F.when(ok, F.floor((reference * 16384 + F.floor(current / 2)) / current))


def normal_category(text: Column) -> Column:
    """Lower case, ends trimmed, white space inside made one space."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def finite(text: Column) -> Column:
    """A number from text, null unless it is finite."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

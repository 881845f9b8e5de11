"""Block statistics and kernels over arrays of samples, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.columns import clamp

SIDE = 8


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def difference(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sse(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")))


def sad(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")))


def variance(a: Column | str, b: Column | str, shift: int = 6) -> Column:
    """Squared error less the squared sum over the block's size, a power of two."""
    s = total(F.transform(difference(a, b), lambda x: x.cast("long")))
    return sse(a, b) - F.shiftright(s * s, shift)


def psnr(error: Column, samples: int = SIDE * SIDE) -> Column:
    """Peak signal-to-noise ratio of 8-bit samples in decibels, 99 where there is no error."""
    return F.when(error == 0, 99.0).otherwise(F.round(10 * F.log10(F.lit(255.0 * 255.0 * samples) / error), 6))


def statistics(pairs: DataFrame) -> DataFrame:
    """All error measures of (vec_id, a, b) rows."""
    spread = F.transform(difference("a", "b"), F.abs)
    rows = pairs.select("vec_id", sse("a", "b").alias("sse"), sad("a", "b").alias("sad"), variance("a", "b").alias("variance"), F.array_min(spread).alias("min_diff"), F.array_max(spread).alias("max_diff"))
    return rows.withColumn("psnr", psnr(F.col("sse")))


def _butterfly(values: Column, stride: int) -> Column:
    """One step of the Hadamard transform along ``stride``."""
    def one(x: Column, i: Column) -> Column:
        low = F.pmod(F.floor(i / stride), F.lit(2)) == 0
        return F.when(low, x + F.get(values, i + stride)).otherwise(F.get(values, i - stride) - x)

    return F.transform(values, one)


def hadamard(values: Column, side: int = SIDE) -> Column:
    """Unscaled two-dimensional Hadamard transform of a block, row by row and column by column."""
    stride = 1
    while stride < side * side:
        values = F.element_at(F.transform(F.array(values), _step(stride)), 1)
        stride *= 2
    return values


def _step(stride: int):
    return lambda v: _butterfly(v, stride)


def satd(a: Column | str, b: Column | str) -> Column:
    """Sum of absolute Hadamard coefficients of the difference."""
    return total(F.transform(hadamard(difference(a, b)), lambda x: F.abs(x).cast("long")))


def residual_added(prediction: Column | str, residual: Column | str, top: int = 255) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: clamp(p + r, 0, top))


def blended(a: Column | str, b: Column | str, mask: Column | str) -> Column:
    """Two blocks blended by a mask of 0..64."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.zip_with(pairs, mask, lambda p, m: F.shiftright(m * p["x"] + (64 - m) * p["y"] + 32, 6))


def averaged(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.shiftright(x + y + 1, 1))


def round_shifted(values: Column | str, bits: int) -> Column:
    return F.transform(values, lambda x: F.shiftright(x + (1 << (bits - 1)), bits))


def halved(values: Column | str, side: int = SIDE) -> Column:
    """Two-to-one box average in both directions."""
    v = F.col(values) if isinstance(values, str) else values
    half = side // 2

    def cell(i: Column) -> Column:
        at = (F.floor(i / half) * 2 * side + (i % half) * 2).cast("int")
        return F.shiftright(F.get(v, at) + F.get(v, at + 1) + F.get(v, at + side) + F.get(v, at + side + 1) + 2, 2)

    return F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), cell)


def dequantised(levels: Column | str, dc: int, ac: int, shift: int = 0) -> Column:
    """Coefficients of levels: magnitude times factor in 24 bits, shifted, held to 16 bits, sign put back."""
    def one(x: Column, i: Column) -> Column:
        size = F.shiftright((F.abs(x) * F.when(i == 0, dc).otherwise(ac)).bitwiseAND(F.lit(0xFFFFFF)), shift)
        return F.when(x < 0, -F.least(size, F.lit(32768))).otherwise(F.least(size, F.lit(32767)))

    return F.transform(levels, one)


def bordered(values: Column | str, side: int = SIDE) -> Column:
    """The block with its edges repeated once on every side."""
    v = F.col(values) if isinstance(values, str) else values
    wide = side + 2

    def cell(i: Column) -> Column:
        y, x = clamp(F.floor(i / wide).cast("int") - 1, 0, side - 1), clamp((i % wide) - 1, 0, side - 1)
        return F.get(v, y * side + x)

    return F.transform(F.sequence(F.lit(0), F.lit(wide * wide - 1)), cell)


def best_references(blocks: DataFrame, reach: int = 8) -> DataFrame:
    """For each block the block among the ``reach`` before it with the least absolute difference, ties to the nearest."""
    offsets = blocks.select("vec_id", F.col("q").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("back")).withColumn("ref", F.col("vec_id") - F.col("back"))
    found = offsets.join(blocks.select(F.col("vec_id").alias("ref"), F.col("q").alias("b")), "ref").select("vec_id", "back", sad("a", "b").alias("sad"))
    return found.groupBy("vec_id").agg(F.min("sad").alias("sad"), F.min_by("back", F.struct("sad", "back")).alias("back"))


def filled(values: Column | str, x: int, y: int, width: int, height: int, value: int, side: int = SIDE) -> Column:
    """The block with a rectangle of one value."""
    inside = lambda i: (i % side).between(x, x + width - 1) & F.floor(i / side).between(y, y + height - 1)
    return F.transform(values, lambda v, i: F.when(inside(i), value).otherwise(v))


def copied(to: Column | str, of: Column | str, to_at: tuple[int, int], of_at: tuple[int, int], width: int, height: int, side: int = SIDE) -> Column:
    """The block with a rectangle of another one; places are (x, y)."""
    source = F.col(of) if isinstance(of, str) else of
    inside = lambda i: (i % side).between(to_at[0], to_at[0] + width - 1) & F.floor(i / side).between(to_at[1], to_at[1] + height - 1)
    moved = (of_at[1] - to_at[1]) * side + of_at[0] - to_at[0]
    return F.transform(to, lambda v, i: F.when(inside(i), F.get(source, i + moved)).otherwise(v))


def distance_blended(a: Column | str, b: Column | str, weight: int) -> Column:
    """Two predictions by weights of sixteen."""
    return F.zip_with(a, b, lambda x, y: F.shiftright(x * weight + y * (16 - weight) + 8, 4))


def difference_blended(a: Column | str, b: Column | str) -> Column:
    """Two predictions by a mask of 64 levels that grows from 38 with their difference."""
    mask = lambda x, y: F.least(F.floor(F.abs(x - y) / 16) + 38, F.lit(64))
    return F.zip_with(a, b, lambda x, y: F.shiftright((x * mask(x, y) + y * (64 - mask(x, y)) + 32).cast("int"), 6))


def half_height(values: Column | str, side: int = SIDE) -> Column:
    """Rows averaged two by two, as chroma of half width becomes chroma of half size."""
    v = F.col(values) if isinstance(values, str) else values

    def cell(i: Column) -> Column:
        at = (F.floor(i / side) * 2 * side + i % side).cast("int")
        return F.shiftright(F.get(v, at) + F.get(v, at + side) + 1, 1)

    return F.transform(F.sequence(F.lit(0), F.lit(side * side // 2 - 1)), cell)


def pyramid(values: Column | str, side: int = SIDE) -> list[Column]:
    """The block and its halves, down to one sample."""
    out = [F.col(values) if isinstance(values, str) else values]
    while side > 1:
        out.append(halved(out[-1], side))
        side //= 2
    return out


def variance_map(values: Column | str, part: int = 4, side: int = SIDE) -> Column:
    """Squares less the square of the sum over the number, rounded down, of each part of the block, row by row."""
    v = F.col(values) if isinstance(values, str) else values
    across, n = side // part, part * part

    def one(k: Column) -> Column:
        base = (F.floor(k / across) * part * side + k % across * part).cast("int")
        own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(v, (base + F.floor(i / part) * side + i % part).cast("int")).cast("long"))
        return F.element_at(F.transform(F.array(own), lambda o: total(F.transform(o, lambda x: x * x)) - F.floor(total(o) * total(o) / n)), 1)

    return F.transform(F.sequence(F.lit(0), F.lit(across * across - 1)), one)


def screen_classes(blocks: DataFrame, picture: str, width: int, height: int) -> DataFrame:
    """The counts and five classes by which a picture passes for screen content.

    ``blocks`` are its 8x8 blocks: ``bx``, ``by`` (from 0) and samples ``q``. Blocks of 16x16 and of
    8x8 count if they have two to four values, and once more if the 16x16 window from their corner
    varies enough; a window beyond the picture repeats its edge.
    """
    d = F.transform("q", lambda x: (x - 128).cast("long"))
    parts = {"all": d, "column": F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(d, i * 8 + 7)), "row": F.slice(d, F.lit(57), F.lit(8)), "corner": F.slice(d, F.lit(64), F.lit(1))}
    times = {"all": 1, "column": 8, "row": 8, "corner": 64}
    sums = [F.struct((total(v) * times[k]).alias("s"), (total(F.transform(v, lambda x: x * x)) * times[k]).alias("e")).alias(k) for k, v in parts.items()]
    own = blocks.select(picture, "bx", "by", F.array_distinct("q").alias("values"), *sums)

    def moved(name: str, dx: int, dy: int) -> DataFrame:
        return own.select(picture, (F.col("bx") - dx).alias("bx"), (F.col("by") - dy).alias("by"), F.struct("values", *parts).alias(name))

    keys = [picture, "bx", "by"]
    all_ = own.join(moved("right", 1, 0), keys, "left").join(moved("below", 0, 1), keys, "left").join(moved("across", 1, 1), keys, "left")
    no_right, no_below = F.col("right").isNull(), F.col("below").isNull()

    def window(f: str) -> Column:
        right = F.when(no_right, F.col(f"column.{f}")).otherwise(F.col(f"right.all.{f}"))
        below = F.when(no_below, F.col(f"row.{f}")).otherwise(F.col(f"below.all.{f}"))
        across = F.when(no_right & no_below, F.col(f"corner.{f}")).when(no_right, F.col(f"below.column.{f}")).when(no_below, F.col(f"right.row.{f}")).otherwise(F.col(f"across.all.{f}"))
        return F.col(f"all.{f}") + right + below + across

    rows = all_.withColumn("spread", window("e") - F.floor(window("s") * window("s") / 256))
    few = lambda v: F.size(v).between(2, 4)
    whole16 = (F.col("bx") % 2 == 0) & (F.col("by") % 2 == 0) & F.col("across").isNotNull()
    four = F.array_distinct(F.concat("values", "right.values", "below.values", "across.values"))
    c16, c8 = whole16 & few(four), few(F.col("values"))
    counts = rows.groupBy(picture).agg(
        F.count_if(c16).alias("c16"), F.count_if(c16 & (F.shiftright(F.col("spread") + 128, 8) > 0)).alias("v16"),
        F.count_if(c8).alias("c8"), F.count_if(c8 & (F.shiftright(F.col("spread") + 32, 6) > 16)).alias("v8"))
    area, n16, m16, n8, m8 = width * height, *(F.col(c) * s for c, s in (("c16", 256), ("v16", 256), ("c8", 64), ("v8", 64)))
    class0 = n16 * 10 > area
    class1 = class0 & (m16 * 12 > area)
    return counts.select(picture, "c16", "v16", "c8", "v8", class0.alias("class0"), class1.alias("class1"), (class1 | ((n16 * 10 > area * 4) & (m16 * 30 > area))).alias("class2"),
                         (class1 | ((n16 * 8 > area) & (m16 * 50 > area))).alias("class3"), ((n8 * 18 > area) & (m8 * 20 > area)).alias("class4"))

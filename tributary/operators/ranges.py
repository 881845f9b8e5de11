"""Joins of values with the intervals that hold them, and piecewise linear scaling by such a join.

Values and intervals meet in buckets of the value's range, so the join is one on equal keys; an interval is copied into
every bucket that it touches. A bucket with many values is dealt to several tasks, with a copy of its intervals in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of a bucket that one task takes.
HOT = 1 << 20


def range_join(values: DataFrame, intervals: DataFrame, keys: list[str], value: str, low: str, high: str, bucket: int, hot: int = HOT, how: str = "inner") -> DataFrame:
    """Each value with every interval of the same ``keys`` that holds it (``low <= value < high``).

    ``bucket`` is the width of a bucket, about that of an interval. ``how`` is ``inner``, or ``left`` to keep values that no
    interval holds. Null values, keys and ends match nothing. Other columns must differ in name.
    """
    # rows are numbered where they are read, so that a task that runs again deals them alike
    at = values.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bucket", F.floor(F.col(value) / bucket))
    busy = at.groupBy(*keys, "_bucket").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("_parts")).filter("_parts > 1")
    # copies of an interval end in its last bucket, and its end isn't in it
    touched = F.sequence(F.floor(F.col(low) / bucket), F.greatest(F.ceil(F.col(high) / bucket) - 1, F.floor(F.col(low) / bucket)))
    spread = intervals.filter(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(touched))
    on = [*keys, "_bucket"]
    part = F.pmod("_row", F.coalesce("_parts", F.lit(1))).cast("int")
    left = at.join(busy, on, "left").withColumn("_part", part).drop("_parts")
    right = spread.join(busy, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    same = [left[c] == right[c] for c in [*on, "_part"]]
    out = left.join(right, [*same, left[value] >= right[low], left[value] < right[high]], how)
    mine = [left[c] for c in values.columns]
    return out.select(*mine, *[right[c] for c in intervals.columns if c not in keys])


def segments(knots: DataFrame, keys: list[str], x: str, y: str, size: int) -> DataFrame:
    """The pieces between knots: keys, low, high, y, next (the value at ``high``) and slope in 16-bit fixed point.

    Before the first knot and behind the last one values are level; pieces cover 0 to ``size``. Knots of a key must differ
    in ``x``. Knots are ordered within a key, of which there are few.
    """
    order = Window.partitionBy(*keys).orderBy("low")
    rows = knots.select(*keys, F.col(x).cast("long").alias("low"), F.col(y).cast("long").alias("y")).withColumn("after", F.lead(F.struct("low", "y")).over(order)).withColumn("before", F.lag("low").over(order))
    width = F.col("after.low") - F.col("low")
    slope = F.coalesce((F.col("after.y") - F.col("y")) * F.floor((65536 + F.shiftright(width, 1)) / width), F.lit(0).cast("long"))
    between = rows.select(*keys, "low", F.coalesce("after.low", F.lit(size).cast("long")).alias("high"), "y", F.coalesce("after.y", "y").alias("next"), slope.alias("slope"))
    ahead = rows.filter("before is null and low > 0").select(*keys, F.lit(0).cast("long").alias("low"), F.col("low").alias("high"), "y", F.col("y").alias("next"), F.lit(0).cast("long").alias("slope"))
    return between.unionByName(ahead).filter("low < high")


def scaled(samples: DataFrame, knots: DataFrame, keys: list[str], sample: str, x: str, y: str, bit_depth: int = 8, hot: int = HOT) -> DataFrame:
    """Samples with ``scaling``, read off the line through the knots of their key; null for a key without knots.

    Knots lie in 0..255. A sample of more than eight bits falls between two places of that range, and its
    scaling between theirs. Samples beyond the range count as its ends.
    """
    shift = bit_depth - 8
    held = F.least(F.greatest(F.col(sample), F.lit(0)), F.lit((1 << bit_depth) - 1)).cast("long")
    rows = samples.withColumn("_index", held).withColumn("_place", F.shiftright("_index", shift))
    out = range_join(rows, segments(knots, keys, x, y, 256), keys, "_place", "low", "high", 16, hot, "left")

    def read(place: Column) -> Column:
        return F.col("y") + F.shiftright((place - F.col("low")) * F.col("slope") + 32768, 16)

    begin, place = read(F.col("_place")), F.col("_place") + 1
    end = F.when(F.col("_place") == 255, begin).when(place == F.col("high"), F.col("next")).otherwise(read(place))
    rest = F.col("_index") - F.shiftleft("_place", shift)
    value = begin if not shift else begin + F.shiftright((end - begin) * rest + (1 << (shift - 1)), shift)
    return out.select(*samples.columns, value.cast("int").alias("scaling"))

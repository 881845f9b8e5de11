"""Set and ordering helpers that the analytics need beside Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys with the place in ``order`` at which each was first seen."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first_seen"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def balanced(rows: DataFrame, keys: list[str], order: str, weight: str, parts: int) -> DataFrame:
    """Consecutive rows of each group dealt into ``parts`` batches of about equal weight."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.sum(weight).over(w) - F.col(weight)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return rows.withColumn("batch", F.least(F.floor(before * parts / F.greatest(total, F.lit(1))), F.lit(parts - 1)))


def temporal_layer_budget(rates: DataFrame, column: str, weights: list[int]) -> DataFrame:
    """A rate split over layers by weight; the last layer takes what rounding leaves."""
    whole = sum(weights)
    parts = [F.floor(F.col(column) * w / whole) for w in weights[:-1]]
    last = F.col(column)
    for p in parts:
        last = last - p
    return rates.select("*", *[p.alias(f"layer{i}") for i, p in enumerate(parts)], last.alias(f"layer{len(parts)}"))


def curve_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Points of a curve in order of metric and rate, with whether a point's metric repeats the one before."""
    w = Window.partitionBy(*keys).orderBy("metric", "rate")
    return rows.select(*keys, "metric", "rate", F.row_number().over(w).cast("long").alias("place"), F.coalesce(F.col("metric") == F.lag("metric").over(w), F.lit(False)).alias("repeats"))


def accepted_curves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The points of the curves on which no metric occurs twice, in order; the other curves are rejected as a whole."""
    judged = rows.groupBy(*keys).agg((F.count_distinct("metric") == F.count("metric")).alias("_sound"))
    return curve_points(rows.join(judged.filter("_sound").drop("_sound"), keys, "left_semi"), keys).drop("repeats")


def labelled_places(rows: DataFrame, group: str, label: str, order: list[str] | None = None) -> DataFrame:
    """Rows with the place of their label among the different labels of their group, ``overall`` first and the others by name."""
    names = rows.select(group, label).distinct()
    w = Window.partitionBy(group).orderBy(F.col(label) != "overall", label)
    return rows.join(names.withColumn("place", F.row_number().over(w).cast("long")), [group, label])


def super_block_refresh(pictures: DataFrame, blocks: int, percent: int) -> DataFrame:
    """The range of blocks that each eligible picture refreshes: it moves on by a share and wraps to 0.

    ``pictures`` has stream, picture and eligible (neither a key nor of an upper layer).
    """
    n = max(1, blocks * percent // 100)
    per_cycle = -(-blocks // n)
    turn = F.sum(F.col("eligible").cast("int")).over(Window.partitionBy("stream").orderBy("picture")) - 1
    start = F.pmod(turn, F.lit(per_cycle)) * n
    return pictures.select("stream", "picture", "eligible", F.when(F.col("eligible"), start).alias("start"), F.when(F.col("eligible"), F.least(start + n, F.lit(blocks))).alias("end"))

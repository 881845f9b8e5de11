"""Folds over ordered rows whose steps are maps of a small state: maps compose, so a long stream is folded in pieces, and pieces of pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levels_of(last: int, piece: int) -> int:
    """How often numbers up to ``last`` are put into pieces until one is left."""
    levels = 1
    while last >= piece**levels:
        levels += 1
    return levels


def states_before(maps: DataFrame, apply: Callable[[Column, Column], Column], compose: Callable[[Column, Column], Column], same: Column, start: Column, kind: str, levels: int, piece: int) -> DataFrame:
    """(stream, at, state) before each map of (stream, at, map), ``at`` being whole numbers from 0.

    ``apply`` gives the state (of type ``kind``) after a map, ``compose`` the map that does one and then another, ``same`` is the map that changes nothing,
    and ``start`` the state before a stream. A task holds one piece at a time, of ``piece`` maps at most.
    """
    pieces = maps.groupBy("stream", F.floor(F.col("at") / piece).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "map"))).alias("steps"))
    if levels > 1:
        whole = pieces.select("stream", F.col("up").alias("at"), F.aggregate("steps", same, lambda m, x: compose(m, x["map"])).alias("map"))
        begun = states_before(whole, apply, compose, same, start, kind, levels - 1, piece).select(F.col("stream").alias("_stream"), F.col("at").alias("_at"), F.col("state").alias("begun"))
        pieces = pieces.join(begun, pieces["stream"].eqNullSafe(begun["_stream"]) & (pieces["up"] == begun["_at"])).select("stream", "up", "steps", "begun")
    else:
        pieces = pieces.withColumn("begun", start)
    walk = F.struct(F.col("begun").alias("state"), F.array().cast(f"array<struct<at:bigint,state:{kind}>>").alias("out"))

    def step(w: Column, x: Column) -> Column:
        return F.struct(apply(x["map"], w["state"]).alias("state"), F.concat(w["out"], F.array(F.struct(x["at"].cast("long").alias("at"), w["state"].alias("state")))).alias("out"))

    return pieces.select("stream", F.explode(F.aggregate("steps", walk, step)["out"]).alias("s")).select("stream", "s.at", "s.state")


def numbered(ranges: DataFrame, low: str, high: str, name: str, block: int = 1 << 13) -> DataFrame:
    """A row for each whole number from ``low`` to ``high``, of a range of any length: it is cut into blocks, and these are written out."""
    first = F.sequence(F.col(low), F.col(high), F.lit(block).cast("long"))
    blocks = ranges.filter(F.col(low) <= F.col(high)).withColumn("_block", F.explode(first))
    return blocks.withColumn(name, F.explode(F.sequence("_block", F.least(F.col("_block") + block - 1, F.col(high))))).drop("_block")

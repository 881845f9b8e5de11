"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.scratch import dropped, written


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest node of its neighbourhood.

    ``both_ways``: the neighbourhood is all neighbours and only larger ones are relinked (large
    star); else it is the smaller neighbours, and the node itself is relinked too (small star).
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if both_ways:
        sides = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        links = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = links.unionByName(least.select("u", F.col("m").alias("v")))
    return links.filter("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) for each node that has an edge; the component is its smallest reachable id.

    Loops and repeated edges are allowed; edges with a null end are left out; an empty table gives
    an empty one. The table is written once per round, and rounds grow with the logarithm of the
    longest path. A hub's edges are only ever grouped with a minimum, so they are combined before
    the shuffle, and joins on a hub are skew joins that the adaptive planner splits.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    now, was = written(e, "cc"), None
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = now.agg(F.count(F.lit(1)), mark).first()
    while seen[0]:
        after = written(_star(_star(now, True), False), "cc")
        state = after.agg(F.count(F.lit(1)), mark).first()
        dropped(was)
        was, now = now, after
        if tuple(state) == tuple(seen):
            break
        seen = state
    dropped(was)
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))

"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest known neighbour, so that components become stars around
their smallest node. All state is in written tables; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.hint("merge").join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.hint("merge").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Edges (u, v), repeated and looped ones allowed, to (node, root): root is the smallest node of the component.

    Only nodes with an edge to another node are returned, roots included. An empty table gives an empty table.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = scratch.table(edges.filter("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == seen:
            break
        seen, old = state, e
        e = scratch.table(_small_star(_large_star(e)))
        scratch.drop(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

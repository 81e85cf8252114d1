"""Connected components by alternating large-star and small-star steps; no links reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v): longs. Rows (node, root) for every node on an edge, root the smallest node reachable.

    A step joins every edge with its end's smallest neighbour, which is a partial aggregate; each round's
    edges are checkpointed to the shared folder. Self-loops and repeated edges change nothing.
    """
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = cut(edges.where("u <> v").select(larger, smaller).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        now = cut(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

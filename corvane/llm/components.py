"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b); the edges have no nulls.

    The edges and those of each round are written to the shared folder; neither nodes nor edges come to the driver. A round
    names its edges twelve times, so a plan that they came with would be planned as often, all in the driver.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # repeats go with those of the whole round
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(smallest.withColumnRenamed("m", "v")).distinct())
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(e.select(F.col("v").alias("node"), F.lit(None).cast("int").alias("below")))
        open_ends = ends.groupBy("node").agg(F.count("below").alias("below"), F.count(F.lit(1)).alias("n")).where("below > 1 or (below = 1 and n > 1)")
        if open_ends.isEmpty():  # each node hangs from one root
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

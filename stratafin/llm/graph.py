"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafin.session import stage


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v), u > v, are the answer: every u has one v, and no v is a u."""
    up = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    down = edges.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs"))
    counts = up.unionByName(down).groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return (counts.agg(F.max(F.col("ups") + F.col("downs"))).first()[0] or 0) <= 1


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any orderable type to (node, root): root is the smallest node reachable.

    Only linked nodes appear.  Each round is two aggregates and two equality joins, whose hot
    nodes AQE splits; edges that touch a null are ignored, loops and repeated edges do no harm.
    Every round is a written table, so a lost executor costs a read, and the number of rounds
    grows with the logarithm of the longest path.  They end with the round that leaves stars, which one
    aggregate tells; no further round has to confirm it.
    """
    current = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u != v").distinct()
    )
    while not _stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))

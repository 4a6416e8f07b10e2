"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links of longs to ``(node, root)``: the smallest node reachable.

    Alternates two steps until nothing changes: every node hands the smallest
    node it knows to its larger neighbours, then to its smaller ones. Each
    step is one shuffle of at most the links given, pre-aggregated where a
    node has many, and the number of rounds grows with the logarithm of the
    longest path. Only a count comes to the driver. Self links and repeated
    links are allowed; nodes without links to others don't appear.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).hint("merge")  # grows with the links, so it isn't broadcast
        # to larger neighbours: (v, smallest around u) for v > u, and u itself
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # to smaller ones: all that u points at point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).hint("merge")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, "links")
        # a round that changes no link has left a star forest: every node points at one root, and no root points on
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")

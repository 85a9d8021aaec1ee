"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node that has an edge to another one.

    Each round every node hands its larger neighbours, then its smaller ones, to the smallest it knows. The edge table
    never grows, its minima are combined before the shuffle, and a round is staged, so lineage stays short.
    """
    x, y = F.col(a), F.col(b)
    now = stage(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "stars")
    was = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            break
        was = mark
        # a pair (a, b) hands a to the smallest node that b knows; staged, so that the join can be split where b is a hub
        low = stage(now.groupBy("a").agg(F.min("b").alias("m")), "star-low").select(F.col("a").alias("b"), "m")
        large = now.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
    else:
        raise RuntimeError("components did not settle")
    root = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())

"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpoint

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node (large: the larger ones, else the smaller ones) to the least of these and itself.

    Only a minimum per node is gathered, so a node with very many neighbours is an aggregate with
    map-side combining and a join that AQE can split, never a list.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    moved = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b; a < b): root is the least node of its component.

    Each round's links are cut off by a checkpoint in the shared folder. Rounds grow with the
    logarithm of the components' diameter.
    """
    now = checkpoint(edges.select("a", "b").where("a < b").distinct())
    sign = None
    for _ in range(MAX_ROUNDS):
        now = checkpoint(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen == sign:
            break
        sign = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

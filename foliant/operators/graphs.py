"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.storage import cut


def components(edges: DataFrame, src: str, dst: str, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of the undirected edges; the label is the least node of its component.

    Each round links all larger neighbours of a node to its least neighbour, then all smaller ones, which reaches a
    fixed point after a number of rounds that grows with the logarithm of the longest path. Null ends and loops are
    ignored. Rounds aggregate before they join, so that a node with very many neighbours is no single task.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    current = cut(pairs.where("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        current = cut(_small_star(_large_star(current)))
        now = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (itself included)."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    out = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the node's least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("y"), "m").unionByName(least.select(F.col("u").alias("y"), "m"))
    return out.where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()

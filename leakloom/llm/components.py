"""Connected components of a graph that is spread over the cluster: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.llm import common


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (a, b): each node's neighbours (large: the larger ones, else the smaller) point to the least around it."""
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))
    pairs = around.join(least, F.col("a") == F.col("k"))
    if large:
        moved = pairs.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def least_reachable(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that it reaches. Loops and repeats are allowed."""
    edges = common.checkpointed(edges.where("a <> b").select("a", "b").distinct())
    state = None
    for _ in range(most_rounds):
        edges = common.checkpointed(stars(stars(edges, True), False))
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = tuple(seen)
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")

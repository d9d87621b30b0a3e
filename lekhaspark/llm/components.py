"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) joined back to the
edges, so the centre of a huge star is never gathered into one task; the number
of steps grows with the logarithm of the component size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node reachable.

    Nodes without an edge to another node are absent. Loops and repeated edges
    are allowed. Raises if `most_rounds` are not enough (2**60 nodes in a chain)."""
    now = written(_small_star(edges.where("a <> b").distinct()), "stars")
    seen = None
    for _ in range(most_rounds):
        before, now = now, written(_small_star(_large_star(now)), "stars")
        forget(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(now.select("b", "b")).distinct()
        seen = mark
    raise RuntimeError("components did not settle")

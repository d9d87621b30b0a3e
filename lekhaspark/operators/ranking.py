"""Ranking operators: similarity, fusion, page and source limits, neighbours, authority, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ranked(hits: DataFrame, score: str, key: str, rank: str = "rank") -> DataFrame:
    """1-based rank over a bounded candidate list."""
    return hits.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of candidate lists (key, rank): key, fused, first (list order for ties)."""
    parts = None
    for i, (hits, weight) in enumerate(lists):
        part = hits.select(key, (F.lit(weight) / (k + F.col("rank"))).alias("s"), F.lit(i).alias("i"), "rank")
        parts = part if parts is None else parts.union(part)
    return parts.groupBy(key).agg(F.sum("s").alias("fused"), F.min(F.struct("i", "rank")).alias("first"))


def first_per(hits: DataFrame, group: list[str], order: list) -> DataFrame:
    """The best row of each group."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def cap_per_source(hits: DataFrame, source: str, order: list, cap: int, top_k: int) -> DataFrame:
    """top_k rows: up to `cap` of a source first, then what is left in order; the result is a bounded report."""
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return hits.withColumn("second_pass", turn > cap).orderBy("second_pass", *order).limit(top_k)


def neighbours(seeds: DataFrame, pages: DataFrame, radius: int, budget: int) -> DataFrame:
    """(doc, page, anchor_page): pages around ranked seeds (doc, page, rank) - nearest first, then seed order, before
    before after; the first claim wins and seeds are not neighbours."""
    steps = F.array(*[F.lit(s * d) for d in range(1, radius + 1) for s in (-1, 1)])
    claims = seeds.select("doc", "page", "rank", F.posexplode(steps).alias("order", "step")).select("doc", (F.col("page") + F.col("step")).alias("page"), F.col("page").alias("anchor_page"), F.abs("step").alias("distance"), "rank", "order")
    claims = claims.join(seeds.select("doc", "page"), ["doc", "page"], "left_anti").join(pages.select("doc", "page"), ["doc", "page"])
    best = first_per(claims, ["doc", "page"], ["distance", "rank", "order"])
    return best.orderBy("distance", "rank", "order").limit(budget).select("doc", "page", "anchor_page")


def authority_score(p: Column, tier: Column, confident: Column, superseded: Column) -> Column:
    """Log-odds of a relevance probability, moved by tier and supersession."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    move = F.when(tier == "A", 1.0).when(tier == "C", F.when(confident, -1.5).otherwise(-1.0)).otherwise(0.0)
    return F.log(q / (1 - q)) + move + F.when(superseded, -2.0).otherwise(0.0)


def relevance(score: Column, all_probabilities: Column) -> Column:
    """Scores as they are when all of a batch lie in 0..1, else their logistic value."""
    return F.when(all_probabilities, score).otherwise(1 / (1 + F.exp(-score)))

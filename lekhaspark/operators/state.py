"""State operators: idempotent merge, scoped prune, latest state, relations, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source win over rows of target with the same key."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def insert_new(target: DataFrame, source: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of source whose key is new, the first by order of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = source.withColumn("_n", turn).where("_n = 1").drop("_n")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def scoped_prune(stored: DataFrame, loaded: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Stored rows without those of loaded sources that the load no longer has."""
    stale = stored.join(loaded.select(source).distinct(), source, "left_semi").join(loaded.select(*keys), keys, "left_anti")
    return stored.join(stale.select(*keys), keys, "left_anti")


def latest(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key; combined before the shuffle."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("entries"))


def later_changes(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """Edges that reach an order by resolved id or by key and date: two equi joins, their union without repeats."""
    by_id = edges.where("target_id is not null").join(orders.select(F.col("id").alias("target_id"), F.col("id").alias("changed")), "target_id").select("source_id", "kind", "changed")
    by_key = edges.join(orders.select(F.col("key").alias("target_key"), F.col("day").alias("target_day"), F.col("id").alias("changed")), ["target_key", "target_day"]).select("source_id", "kind", "changed")
    return by_id.union(by_key).where("source_id <> changed").distinct()


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha, first): the smallest key with the same text."""
    hashed = docs.select(key, F.sha2(text, 256).alias("sha"))
    return hashed.join(hashed.groupBy("sha").agg(F.min(key).alias("first"), F.count("*").alias("copies")), "sha").where("copies > 1")

"""Relations between orders: references found in subjects and pages, and links of a reviewed catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import go_key


def build_relations(references: DataFrame, catalogue: DataFrame, orders: DataFrame) -> DataFrame:
    """references: source_id, place (0 subject, else the page), found_in, target_key, target_date, kind, evidence.
    catalogue: source_id, target_id, kind. orders: source_id, go_number, go_date.

    One row for each order and target: of its references the first that says more than "refers", else the first; a
    catalogue link takes the place of either. target_source_id is
    the one other order with that number and date, null if there are several."""
    known = orders.select("source_id", go_key(F.col("go_number")).alias("target_key"), F.col("go_date").alias("target_date")).where("target_key is not null and target_date is not null")
    targets = known.groupBy("target_key", "target_date").agg(F.count("*").alias("_n"), F.min("source_id").alias("_lo"), F.max("source_id").alias("_hi"))
    rank = F.struct(F.when(F.col("kind") == "refers", 1).otherwise(0).alias("weak"), F.col("place"), F.col("kind"))
    best = references.groupBy("source_id", "target_key", "target_date").agg(F.min_by(F.struct("kind", "found_in", "evidence"), rank).alias("r"))
    best = best.select("source_id", "target_key", "target_date", "r.*").join(targets, ["target_key", "target_date"], "left")
    one = F.when(F.col("_n") == 1, F.when(F.col("_lo") != F.col("source_id"), F.col("_lo"))).when((F.col("_n") == 2) & (F.col("_lo") == F.col("source_id")), F.col("_hi")).when((F.col("_n") == 2) & (F.col("_hi") == F.col("source_id")), F.col("_lo"))
    found = best.select("source_id", "target_key", "target_date", "kind", "found_in", F.substring("evidence", 1, 300).alias("evidence"), one.alias("target_source_id"))
    links = catalogue.join(known.withColumnRenamed("source_id", "target_id"), "target_id").select(
        "source_id", "target_key", "target_date", "kind", F.lit("catalogue").alias("found_in"), F.lit("catalogue").alias("evidence"), F.col("target_id").alias("target_source_id")
    )
    last = Window.partitionBy("source_id", "target_key", "target_date").orderBy(F.col("found_in") != "catalogue", F.desc("target_source_id"))
    return found.union(links).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def relation_counts(relations: DataFrame) -> DataFrame:
    """kind, relations, resolved."""
    return relations.groupBy("kind").agg(F.count("*").alias("relations"), F.count("target_source_id").alias("resolved"))


def mark_superseded(orders: DataFrame, relations: DataFrame) -> DataFrame:
    """orders with superseded: whether any resolved relation supersedes them."""
    gone = relations.where("kind = 'supersedes' and target_source_id is not null").select(F.col("target_source_id").alias("source_id")).distinct().withColumn("superseded", F.lit(True))
    return orders.join(gone, "source_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))

"""Audits of a corpus: numbers on which extractions disagree, lengths, scripts, recommendations, what each document is made of, and storage by tier.

Order statistics are taken from counts of equal values, so no group is ever collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DEVANAGARI, LATIN, numeric_tokens

SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
SHORT, LONG = 120, 1900


def numeric_conflicts(variants: DataFrame) -> DataFrame:
    """variants (source_id, page_number, variant_id, variant_type, canonical, text) -> (source_id, page_number, native_only, ocr_only, conflict): of pages with a native text and an OCR text that is not
    canonical (the first by variant_id of each), the numbers that only one has, and whether there are any. Other pages have no conflict and no row."""
    native = F.col("variant_type") == "native"
    ocr = (F.col("variant_type") == "ocr") & ~F.coalesce("canonical", F.lit(False))
    first = lambda is_: F.min_by(numeric_tokens(F.coalesce("text", F.lit(""))), F.when(is_, F.col("variant_id")))
    kinds = variants.where(native | ocr).groupBy("source_id", "page_number").agg(F.bool_or(native).alias("_n"), F.bool_or(ocr).alias("_o"), first(native).alias("n"), first(ocr).alias("o"))
    apart = kinds.where("_n and _o").select("source_id", "page_number", F.array_sort(F.array_except("n", "o")).alias("native_only"), F.array_sort(F.array_except("o", "n")).alias("ocr_only"))
    return apart.withColumn("conflict", F.size("native_only") + F.size("ocr_only") > 0)


def length_report(chunks: DataFrame, by: str) -> DataFrame:
    """chunks (by, source_id, page_number, length) -> one row for each value of `by`: chunks, documents, pages, shortest, the values at the lower index of SHARES, longest, under SHORT, over LONG."""
    counts = chunks.groupBy(by, "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    placed = counts.withColumn("upto", F.sum("n").over(w.orderBy("length").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    # the value at index floor((all - 1) * share) is the first whose running count is beyond it
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * share), F.col("length"))).alias(name) for name, share in SHARES.items()]
    stats = placed.groupBy(by).agg(F.sum("n").alias("chunks"), F.min("length").alias("shortest"), *at, F.max("length").alias("longest"), F.coalesce(F.sum(F.when(F.col("length") < SHORT, F.col("n"))), F.lit(0)).alias("short"), F.coalesce(F.sum(F.when(F.col("length") > LONG, F.col("n"))), F.lit(0)).alias("long"))
    pages = chunks.groupBy(by, "source_id").agg(F.count_distinct("page_number").alias("pages")).groupBy(by).agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"))
    return stats.join(pages, by)


def script_report(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, hindi, latin, ratio): letters of both scripts, and the share of Devanagari among them, null without letters."""
    counted = docs.select(key, F.regexp_count(text, F.lit(DEVANAGARI)).alias("hindi"), F.regexp_count(text, F.lit(LATIN)).alias("latin"))
    return counted.withColumn("ratio", F.col("hindi") / F.nullif(F.col("hindi") + F.col("latin"), F.lit(0)))


def class_counts(pages: DataFrame, document: str, label: str, order: list[str]) -> DataFrame:
    """(label, pages, documents): pages and documents of each class in a fixed order, also of classes that no page has."""
    found = pages.groupBy(label, document).agg(F.count("*").alias("n")).groupBy(label).agg(F.sum("n").alias("pages"), F.count("*").alias("documents"))
    names = pages.sparkSession.createDataFrame(list(enumerate(order)), f"place int, {label} string")
    return names.join(found, label, "left").select(label, "place", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("documents", F.lit(0)).alias("documents"))


def extraction_report(pages: DataFrame) -> DataFrame:
    """pages (source_id, text_source: native or ocr, legacy, text) -> (source_id, pages, text_source: native, ocr or mixed, legacy_pages, n_bytes)."""
    kinds = F.count_distinct("text_source")
    return pages.groupBy("source_id").agg(F.count("*").alias("pages"), F.when(kinds > 1, "mixed").otherwise(F.min("text_source")).alias("text_source"), F.count_if(F.coalesce("legacy", F.lit(False))).alias("legacy_pages"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"))


def storage_report(files: DataFrame, expected: int) -> DataFrame:
    """files (source_id, tier, kind: original, image or other, n_bytes, evicted) -> one row for each tier: orders, original, image, other (bytes), evicted, kept (orders), and projected: bytes of a corpus of
    `expected` orders of which this tier has the share that it has now."""
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n_bytes"))), F.lit(0)).alias(k) for k in ("original", "image", "other")]
    order = files.groupBy(F.coalesce("tier", F.lit("none")).alias("tier"), "source_id").agg(*sums, F.bool_or(F.coalesce("evicted", F.lit(False))).alias("evicted"))
    tiers = order.groupBy("tier").agg(F.count("*").alias("orders"), *[F.sum(k).alias(k) for k in ("original", "image", "other")], F.count_if("evicted").alias("evicted"))
    whole = F.sum("orders").over(Window.partitionBy())  # one row for each tier
    each = (F.col("original") + F.col("image") + F.col("other")) / F.col("orders")
    return tiers.withColumn("kept", F.col("orders") - F.col("evicted")).withColumn("projected", each * F.col("orders") / whole * expected)

"""From fused hits to evidence: pools for reranking, alternate variants, exact pages, hydration, closest documents.

Hits have a query column, page (logical page), variant and rank (1 is best); one query or millions are the same plan:
every window is partitioned by the query, whose hits are a bounded retrieval list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Alternate variants that one query may add to its pool.
ALTERNATES = 8


def rerank_pool(hits: DataFrame, count: int, top_k: int, query: str = "query") -> DataFrame:
    """The first `count` hits, each page once (its best hit). If fewer pages than min(top_k, count) are left, lower
    hits of new pages fill up. Adds pool_rank and backfilled."""
    page = Window.partitionBy(query, "page").orderBy("rank")
    unique = hits.withColumn("_n", F.row_number().over(page)).where("_n = 1").drop("_n")
    placed = unique.withColumn("pool_rank", F.row_number().over(Window.partitionBy(query).orderBy("rank")))
    inside = F.col("rank") <= count
    return placed.where(inside | (F.col("pool_rank") <= min(top_k, count))).withColumn("backfilled", ~inside)


def alternates(hits: DataFrame, pool: DataFrame, budget: int = ALTERNATES, query: str = "query") -> DataFrame:
    """The best hit of another variant of each pooled page, `budget` of them for a query."""
    chosen = pool.select(query, "page", F.col("variant").alias("_chosen"))
    other = hits.join(chosen, [query, "page"]).where("variant <> _chosen").drop("_chosen")
    first = other.withColumn("_n", F.row_number().over(Window.partitionBy(query, "page").orderBy("rank"))).where("_n = 1").drop("_n")
    return first.withColumn("alternate", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).where(F.col("alternate") <= budget)


def readable_variant(variants: DataFrame) -> DataFrame:
    """Of each page (source_id, page_number) the variant with the longest text; the canonical one, then the least id, of equals."""
    order = Window.partitionBy("source_id", "page_number").orderBy(F.desc(F.length("text")), F.desc("canonical"), "variant_id")
    return variants.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def exact_pages(asked: DataFrame, variants: DataFrame) -> DataFrame:
    """asked (query, pages: array of struct(source_id, page_number)) -> the readable variant of each page that exists, in
    the caller's order, labelled S1, S2, ... without gaps."""
    each = asked.select("query", F.posexplode("pages").alias("_at", "p")).select("query", "_at", "p.source_id", "p.page_number")
    wanted = variants.join(each.select("source_id", "page_number").distinct(), ["source_id", "page_number"], "left_semi")
    met = each.join(readable_variant(wanted), ["source_id", "page_number"])
    place = F.row_number().over(Window.partitionBy("query").orderBy("_at"))
    return met.withColumn("label", F.concat(F.lit("S"), place.cast("string"))).drop("_at")


def page_url(metadata, source_url, page_number):
    """The page's own address where the metadata has one (counted from 0), else the document's with #page=N."""
    urls = F.from_json(F.get_json_object(metadata, "$.pageUrls"), "array<string>")
    return F.coalesce(F.nullif(F.get(urls, page_number - 1), F.lit("")), F.concat(source_url, F.lit("#page="), page_number.cast("string")))


def has_legacy_font(metadata, page_number):
    """Whether the metadata lists the page, or counts any page, as printed in a legacy font."""
    listed = F.from_json(F.get_json_object(metadata, "$.html.legacyFontPages"), "array<int>")
    counted = F.get_json_object(metadata, "$.pageCorpus.krutiDevPages").cast("int")
    return F.coalesce(F.array_contains(listed, page_number), F.lit(False)) | (F.coalesce(counted, F.lit(0)) > 0)


def hydrate(hits: DataFrame, variants: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (query, source_id, page_number, variant_id, numeric_conflict) with selected_text, canonical_text, other_texts (only
    of conflicting pages, without repeats of these two), page_url and legacy_font. The variants of a page meet in one row first."""
    text = F.struct("variant_id", "text", "canonical")
    asked = hits.select("source_id", "page_number").distinct()
    pages = variants.join(asked, ["source_id", "page_number"], "left_semi").groupBy("source_id", "page_number").agg(F.array_sort(F.collect_list(text)).alias("_v"))
    met = hits.join(pages, ["source_id", "page_number"], "left").join(documents.select("source_id", "source_url", "metadata"), "source_id", "left")
    first = lambda keep: F.get(F.transform(F.filter("_v", keep), lambda v: v["text"]), F.lit(0))
    selected = first(lambda v: v["variant_id"] == F.col("variant_id"))
    met = met.withColumn("selected_text", selected).withColumn("canonical_text", F.coalesce(first(lambda v: v["canonical"]), "selected_text"))
    own = lambda v: (v["variant_id"] == F.col("variant_id")) | (F.coalesce(v["text"], F.lit("")) == "") | (v["text"] == F.coalesce("selected_text", F.lit(""))) | (v["text"] == F.coalesce("canonical_text", F.lit("")))
    others = F.transform(F.filter("_v", lambda v: ~own(v)), lambda v: v["text"])
    met = met.withColumn("other_texts", F.when(F.col("numeric_conflict"), others).otherwise(F.array().cast("array<string>")))
    met = met.withColumn("page_url", page_url(F.col("metadata"), F.col("source_url"), F.col("page_number"))).withColumn("legacy_font", has_legacy_font(F.col("metadata"), F.col("page_number")))
    return met.drop("_v", "metadata")


def closest_documents(evidence: DataFrame, least: float = 0.0, limit: int = 3) -> DataFrame:
    """Of each query the first `limit` documents with a title, by their best page: title (cut to 140) and reference."""
    usable = evidence.where((F.col("relevance") >= least) & (F.coalesce("role", F.lit("")) != "neighbor"))
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    best = usable.withColumn("_n", F.row_number().over(Window.partitionBy("query", "source_id").orderBy("rank"))).where("_n = 1").withColumn("title", title).where("title <> ''")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("place") <= limit)
    short = F.when(F.length("title") > 140, F.concat(F.substring("title", 1, 137), F.lit("…"))).otherwise(F.col("title"))
    reference = F.nullif(F.concat_ws(", ", F.nullif("go_number", F.lit("")), F.nullif("go_date", F.lit(""))), F.lit(""))
    return best.select("query", "place", "source_id", short.alias("title"), reference.alias("reference"))


def stale_embeddings(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Chunks (text, embedding_model, embedding_dim, embedding_hash) that have no embedding of this model, size and text."""
    known = F.col("embedding_model").eqNullSafe(F.lit(model)) & F.col("embedding_dim").eqNullSafe(F.lit(dimensions)) & F.col("embedding_hash").eqNullSafe(F.sha2("text", 256))
    return chunks.where(~known)


def corpus_audit(pages: DataFrame) -> DataFrame:
    """pages (source_id, page_number, text_source, text, legacy_font) -> one row for each document: pages, text_source
    (native, ocr or mixed), legacy_pages, text_bytes."""
    return pages.groupBy("source_id").agg(
        F.count("*").alias("pages"),
        F.when(F.min("text_source") == F.max("text_source"), F.min("text_source")).otherwise("mixed").alias("text_source"),
        F.count_if("legacy_font").alias("legacy_pages"),
        F.sum(F.octet_length("text")).alias("text_bytes"),
    )

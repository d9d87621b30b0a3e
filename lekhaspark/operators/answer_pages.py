"""What an answer may stand on: pages that are relevant enough with their neighbours, a page of listed orders filled up by likeness, and a portal's capture by listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = 10
LEAST_SIMILARITY, SPREAD = 0.45, 0.12
DEFAULT_PAGE_SIZE = 100


def relevant(evidence: DataFrame, least: float) -> DataFrame:
    """evidence (query, source_id, page_number, role, anchor_page, score) -> its columns, relevance (of direct pages), kept, best. Scores of the direct pages of a query are
    probabilities if all finite ones lie in 0 to 1, else logits; others than finite ones are 0. A neighbour is kept with the page that pulled it in, so only if
    that one is. best is the highest relevance of a query's direct pages, 0 without any."""
    direct = F.coalesce("role", F.lit("direct")) != "neighbor"
    score = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    e = evidence.withColumn("_direct", direct).withColumn("_s", F.when(direct, score))
    whole = Window.partitionBy("query")
    as_is = F.coalesce(F.bool_and(F.col("_s").between(0.0, 1.0)).over(whole), F.lit(False))
    mapped = F.coalesce(F.when(as_is, F.col("_s")).otherwise(1 / (1 + F.exp(-F.col("_s")))), F.lit(0.0))
    e = e.withColumn("relevance", F.when(F.col("_direct"), mapped))
    page = F.struct("source_id", F.col("page_number").cast("int").alias("page"))
    good = F.collect_set(F.when(F.col("relevance") >= least, page)).over(whole)
    anchor = F.struct("source_id", F.col("anchor_page").cast("int").alias("page"))
    kept = F.when(F.col("_direct"), F.col("relevance") >= least).otherwise(F.col("anchor_page").isNotNull() & F.array_contains(good, anchor))
    return e.select(*evidence.columns, "relevance", kept.alias("kept"), F.coalesce(F.max("relevance").over(whole), F.lit(0.0)).alias("best"))


def filled_page(hits: DataFrame, similar: DataFrame, size: int = PAGE, least: float = LEAST_SIMILARITY, spread: float = SPREAD) -> DataFrame:
    """hits (query, id, place), similar (query, id, similarity) -> (query, id, place, found: words or similar): the hits by words, then, where they fill no page, what is most
    alike, down to the best likeness less `spread` and `least` at the least, each once."""
    first = hits.where(F.col("place") <= size)
    floor = F.greatest(F.lit(least), F.max("similarity").over(Window.partitionBy("query")) - spread)
    near = similar.withColumn("_floor", floor).where(F.col("similarity") >= F.col("_floor")).join(first.select("query", "id"), ["query", "id"], "left_anti")
    both = first.select("query", "id", F.lit(0).alias("o"), F.col("place").cast("double").alias("k"), F.lit("words").alias("found")).union(near.select("query", "id", F.lit(1), -F.col("similarity"), F.lit("similar")))
    n = F.row_number().over(Window.partitionBy("query").orderBy("o", "k", "id"))
    return both.withColumn("place", n).where(F.col("place") <= size).select("query", "id", "place", "found")


def capture_report(log: DataFrame, inventory: DataFrame, statuses: DataFrame, complete: DataFrame) -> DataFrame:
    """log (listing, number, portal_page, rows, total, page_size, reshuffle), inventory (listing, source_id), statuses (source_id, number, state), complete (listing) -> one row for each
    listing: pages, rows, total, page_size, reshuffles, orders, archived, unavailable, retry, waiting, missing_pages, state. Of reshuffled pages only their number counts; total and page size
    are the last ones named, a listing that names no size has pages of DEFAULT_PAGE_SIZE; of an order its last state counts."""
    seen = F.when(~F.coalesce("reshuffle", F.lit(False)), F.lit(True))
    last = lambda c: F.max_by(c, F.when(seen & F.col(c).isNotNull(), F.col("number")))
    pages = log.groupBy("listing").agg(
        F.count_distinct(F.when(seen, F.col("portal_page"))).alias("pages"), F.coalesce(F.sum(F.when(seen, F.col("rows"))), F.lit(0)).alias("rows"), last("total").alias("total"),
        F.coalesce(last("page_size"), F.when(F.count(seen) > 0, DEFAULT_PAGE_SIZE)).alias("page_size"), F.count_if(F.coalesce("reshuffle", F.lit(False))).alias("reshuffles"),
    )
    state = statuses.groupBy("source_id").agg(F.max_by("state", "number").alias("state"))
    counted = inventory.join(state, "source_id", "left").groupBy("listing").agg(
        F.count("*").alias("orders"), F.count_if(F.col("state").isin("stored", "skipped")).alias("archived"), F.count_if(F.col("state") == "unavailable").alias("unavailable"), F.count_if(F.col("state") == "retry").alias("retry"),
    )
    met = pages.join(counted, "listing", "full").join(complete.select("listing").distinct().withColumn("_done", F.lit(True)), "listing", "left")
    for c in ("pages", "rows", "reshuffles", "orders", "archived", "unavailable", "retry"):
        met = met.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    expected = F.when((F.col("total") > 0) & (F.col("page_size") > 0), F.ceil(F.col("total") / F.col("page_size")).cast("long"))
    short = F.col("total") - F.col("orders")
    met = met.withColumn("waiting", F.col("orders") - F.col("archived") - F.col("unavailable") - F.col("retry")).withColumn("missing_pages", expected - F.col("pages"))
    done = F.when(short > 0, F.concat(F.lit("complete, "), short.cast("string"), F.lit(" orders fewer than the portal total (reshuffled/duplicate rows)"))).otherwise("complete")
    word = F.when(F.col("_done"), done).when(F.col("missing_pages") != 0, F.concat(F.col("missing_pages").cast("string"), F.lit(" pages to capture"))).otherwise("capture open")
    return met.select("listing", "pages", "rows", "total", "page_size", "reshuffles", "orders", "archived", "unavailable", "retry", "waiting", "missing_pages", word.alias("state"))

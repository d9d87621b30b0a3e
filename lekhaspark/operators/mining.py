"""Training pairs and evaluation: keyword candidates by TF-IDF, ranks of the right page, negatives, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]{2,}"


def _raw_weights(pages: DataFrame, least: int, most: float) -> DataFrame:
    """(page, term, w): 1 + ln(count) times smoothed inverse document frequency. Texts are dealt by page before they are words: they are
    shorter, and the counts of a page stay where they are."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    # the outer form, since Spark would else infer a filter that makes the words a second time
    each = pages.select("page", "text").repartition("page").select("page", F.explode_outer(words).alias("term")).where("term is not null")
    counts = each.groupBy("page", "term").agg(F.count("*").alias("tf"))
    n = pages.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).join(n).where((F.col("df") >= least) & (F.col("df") <= F.lit(most) * F.col("n")))
    held = counts.where("page is not null").join(df, "term")
    return held.select("page", "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))


def _norms(raw: DataFrame) -> DataFrame:
    return raw.groupBy("page").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def tfidf(pages: DataFrame, least: int = 2, most: float = 0.3) -> DataFrame:
    """pages (page, text) -> (page, term, weight): 1 + ln(count) times smoothed inverse document frequency, of length one for
    each page; terms of fewer than `least` pages or more than a share `most` of them are left out. Counts are combined before
    each shuffle, so a common term is one row a task."""
    raw = _raw_weights(pages, least, most)
    return raw.join(_norms(raw), "page").select("page", "term", (F.col("w") / F.col("norm")).alias("weight"))


def keyword_candidates(questions: DataFrame, pages: DataFrame, top_k: int, least: int = 2, most: float = 0.3) -> DataFrame:
    """(query, page, score): the top_k pages of each question (query, question) by TF-IDF; only the questions' terms are
    joined, before they meet the lengths of their pages, so the pages' other words never move for them."""
    raw = _raw_weights(pages, least, most)
    words = F.regexp_extract_all(F.lower("question"), F.lit(WORD), F.lit(0))
    asked = questions.select("query", F.explode(words).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf")).withColumn("q", 1 + F.log("tf"))
    picked = asked.select("query", "term", "q").join(raw, "term").join(_norms(raw), "page")
    scored = picked.groupBy("query", "page").agg(F.round(F.sum(F.col("q") * (F.col("w") / F.col("norm"))), 9).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "page")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top_k)


def positive_ranks(candidates: DataFrame) -> DataFrame:
    """candidates (query, page, score, positive) -> (query, positive_score, rank): the right page's place among the candidates;
    a wrong page of equal score stands behind it."""
    right = candidates.where("positive").groupBy("query").agg(F.max("score").alias("positive_score"))
    ahead = candidates.where("not positive").join(right, "query").groupBy("query").agg(F.count_if(F.col("score") > F.col("positive_score")).alias("ahead"))
    return right.join(ahead, "query", "left").select("query", "positive_score", (F.coalesce("ahead", F.lit(0)) + 1).alias("rank"))


def mined_negatives(candidates: DataFrame, count: int, share: float = 0.95) -> DataFrame:
    """(query, page, place, uncertain): wrong pages by score, best first. One that reaches `share` of the right page's score may
    answer as well: it is uncertain and does not count among the `count` that are taken."""
    right = candidates.where("positive").groupBy("query").agg(F.max("score").alias("positive_score"))
    wrong = candidates.where("not positive").join(right, "query").withColumn("uncertain", F.col("score") >= F.lit(share) * F.col("positive_score"))
    place = F.row_number().over(Window.partitionBy("query", "uncertain").orderBy(F.desc("score"), "page"))
    return wrong.withColumn("place", place).where(F.col("uncertain") | (F.col("place") <= count)).select("query", "page", "place", "uncertain")


def retrieval_report(ranks: DataFrame) -> DataFrame:
    """One row: questions, share of right pages first, share among the first four, mean reciprocal rank of the first ten."""
    reciprocal = F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)
    return ranks.agg(F.count("*").alias("questions"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("first"), F.round(F.avg((F.col("rank") <= 4).cast("double")), 6).alias("in_top_4"), F.round(F.avg(reciprocal), 6).alias("mrr_10"))


def accept_if_better(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the reciprocal ranks of two rankings and whether the second is to be kept."""
    a, b = (retrieval_report(d).select(F.col("mrr_10").alias(n)) for d, n in ((before, "before"), (after, "after")))
    return a.join(b).select("before", "after", (F.col("after") > F.col("before")).alias("accepted"))


def bake_off(results: DataFrame) -> DataFrame:
    """results (model, case_id, passed, validated, ms) -> one row for each model: cases, shares, median time; best first."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate")
    return results.groupBy("model").agg(F.count("*").alias("cases"), share("passed"), share("validated"), F.expr("percentile(ms, 0.5)").alias("median_ms")).orderBy(F.desc("passed_rate"), "model")


def side_by_side(results: DataFrame, models: list[str]) -> DataFrame:
    """One row for each case, with a column for each model that says whether it passed."""
    return results.groupBy("case_id").pivot("model", models).agg(F.bool_and("passed"))


def ocr_parts(batches: DataFrame) -> DataFrame:
    """batches (batch, pages: array of page ids, text with lines "=== PAGE n ===") -> (batch, page, text) where the markers are just
    1..n in order; other batches give no row and are to be read again."""
    parts = F.split("text", r"(?m)^=== PAGE \d+ ===\s*$")
    marks = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^=== PAGE (\d+) ===\s*$"), F.lit(1)), lambda x: x.cast("int"))
    good = (F.size(marks) == F.size("pages")) & (F.size("pages") > 0) & (marks == F.sequence(F.lit(1), F.size("pages"))) & (F.trim(F.regexp_replace(parts[0], r"\s+", " ")) == "")
    kept = batches.where(F.coalesce(good, F.lit(False)))
    return kept.select("batch", F.inline(F.arrays_zip(F.col("pages").alias("page"), F.slice(parts, 2, F.size("pages")).alias("text")))).select("batch", "page", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


#: Shares of a sample by kind of document, and pages of one document at most.
SHARES = {"rulebook": (0.35, 8), "order": (0.55, 3), "other": (0.10, 4)}


def sample_pages(pages: DataFrame, total: int, excluded: DataFrame, shares: dict[str, tuple[float, int]] = SHARES) -> DataFrame:
    """pages (kind, source_id, page) -> a fixed sample of about `total`: of each kind its share, of a document no more pages than
    the kind allows, in the order of a hash; documents of `excluded` (source_id) are left out."""
    turn = F.sha2(F.concat_ws("|", "source_id", F.col("page").cast("string")), 256)
    held = pages.join(excluded.select("source_id").distinct(), "source_id", "left_anti").withColumn("_h", turn)
    out = None
    for kind, (share, quota) in shares.items():
        own = held.where(F.col("kind") == kind).withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("_h"))).where(F.col("_n") <= quota)
        part = own.orderBy("_h").limit(int(total * share + 0.5))
        out = part if out is None else out.union(part)
    return out.select(pages.columns)


def is_dev(source_id, percent: int = 8):
    """Whether a document belongs to the test half: by a hash of its id, so that all its pages go together."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("dev|"), source_id), 256), 1, 8), 16, 10).cast("long") % 100 < percent


def training_rows(candidates: DataFrame, count: int, overlap: float = 0.6) -> DataFrame:
    """candidates (query, source_id, positive_source, rank, words, positive_words: arrays) -> (query, negatives, dev): wrong pages of
    other documents that share less than `overlap` of the smaller word set with the right page, best first, `count` at
    most. Questions of test documents take any; training rows with a test document among their negatives are dropped, and
    so are rows with fewer than two."""
    shared = F.coalesce(F.size(F.array_intersect("words", "positive_words")) / F.nullif(F.least(F.size("words"), F.size("positive_words")), F.lit(0)), F.lit(0.0))
    good = candidates.where((F.col("source_id") != F.col("positive_source")) & (shared < overlap))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    kept = good.withColumn("place", place).where(F.col("place") <= count)
    rows = kept.groupBy("query").agg(
        F.first(is_dev(F.col("positive_source"))).alias("dev"), F.bool_or(is_dev(F.col("source_id"))).alias("mixed"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id"))), lambda x: x["source_id"]).alias("negatives"),
    )
    return rows.where((F.size("negatives") >= 2) & (F.col("dev") | ~F.col("mixed"))).select("query", "negatives", "dev")

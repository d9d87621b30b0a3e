"""What a new capture is a copy of: the same file, the same text, or the same order in other words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, order_key, word_set

#: Words that either text must have to be compared, and the share of the smaller set that makes one order.
LEAST_WORDS, SAME_ORDER = 15, 0.5


def _last(known: DataFrame, key: str) -> DataFrame:
    """For each hash the entry that counts: the last one in the order of the archive's ids."""
    return known.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("source_id").alias("_of"))


def find_duplicates(new: DataFrame, known: DataFrame) -> DataFrame:
    """new and known: source_id, file_hash, text_hash, go_number, go_date, text. One row for each new capture that is a copy:
    source_id, kind (exact, same-order or possible), of, reason, score.

    A file hash decides before a text hash. Else candidates share the order key; the best overlap of words of at least
    half makes it the same order. If texts were compared and differ, it is none; if none could be compared, it is possible."""
    by_file = new.join(_last(known, "file_hash"), "file_hash").select("source_id", F.col("_of").alias("of"), F.lit("same file").alias("reason"), F.lit(1).alias("_p"))
    by_text = new.join(_last(known, "text_hash"), "text_hash").select("source_id", F.col("_of").alias("of"), F.lit("same text").alias("reason"), F.lit(2).alias("_p"))
    exact = by_file.union(by_text).groupBy("source_id").agg(F.min_by(F.struct("of", "reason"), "_p").alias("x"))
    exact = exact.select("source_id", F.lit("exact").alias("kind"), "x.of", "x.reason", F.lit(None).cast("double").alias("score"))
    rest = new.join(exact.select("source_id"), "source_id", "left_anti")
    key = lambda d: d.withColumn("_key", order_key(F.col("go_number"), F.col("go_date"))).where("_key is not null")
    a = key(rest).select("source_id", "_key", word_set(F.coalesce("text", F.lit(""))).alias("_a"))
    b = key(known).select(F.col("source_id").alias("of"), "_key", word_set(F.coalesce("text", F.lit(""))).alias("_b"))
    comparable = (F.size("_a") >= LEAST_WORDS) & (F.size("_b") >= LEAST_WORDS)
    score = F.when(comparable, F.size(F.array_intersect("_a", "_b")) / F.least(F.size("_a"), F.size("_b"))).otherwise(0.0)
    met = a.join(b, "_key").select("source_id", "of", score.alias("score"), comparable.alias("compared"))
    best = met.groupBy("source_id").agg(F.max(F.struct("score", F.lit(0).alias("_"))).getField("score").alias("score"), F.bool_or("compared").alias("compared"), F.min_by("of", F.struct((-F.col("score")).alias("s"), "of")).alias("best"), F.min("of").alias("first"))
    same = F.col("score") >= SAME_ORDER
    words = F.concat(F.lit("same number and date; "), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("% of words shared"))
    order = best.where(same | ~F.col("compared")).select(
        "source_id", F.when(same, "same-order").otherwise("possible").alias("kind"), F.when(same, F.col("best")).otherwise(F.col("first")).alias("of"),
        F.when(same, words).otherwise("same number and date; text not comparable (scan)").alias("reason"), F.when(same, F.col("score")).alias("score"),
    )
    return exact.union(order)


#: Words of the left texts that are sent to the tasks; with more, words meet in a shuffled join.
MOST_WORDS = 100_000


def overlap_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left (a, words), right (b, words: arrays of distinct words) -> (a, b, overlap): pairs that share `least` or more of the smaller
    set. Of the smaller set only the words that come first, as many as cannot all be missing, look for partners: on the right the words that no
    left text has, which find none, then the rarest. So common words make no pairs, and words that only the right has leave at once; sets are compared for what is left."""
    # the outer form, since Spark would else infer a filter that makes the words a second time
    each = lambda d, *cols: d.select(*cols, F.explode_outer("words").alias("w")).where("w is not null")
    known = each(left).distinct()
    counts = known.join(each(right).groupBy("w").agg(F.count("*").alias("df")), "w", "left").select("w", F.coalesce("df", F.lit(0)).alias("df"))
    if known.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
        counts = F.broadcast(counts)

    def words(d: DataFrame, key: str, n: str) -> DataFrame:
        met = each(d, key, F.size("words").alias(n)).join(counts, "w")
        own = Window.partitionBy(key)
        place = F.col(n) - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "w"))
        return met.withColumn("first", place <= F.col(n) - F.ceil(F.lit(least) * F.col(n)) + 1)

    # seek 0: first words of the left among all of the right; 1: first words of the right among all of the left
    sides = lambda k: F.explode(F.when(F.col("first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(k)))).alias("seek")
    a, b = words(left, "a", "n_a").select("a", "n_a", "w", sides(1)), words(right, "b", "n_b").select("b", "n_b", "w", sides(0))
    smaller = F.when(F.col("seek") == 0, F.col("n_a") <= F.col("n_b")).otherwise(F.col("n_b") < F.col("n_a"))
    met = a.join(b, ["w", "seek"]).where(smaller).select("a", "b").distinct().join(left.select("a", F.col("words").alias("_a")), "a").join(right.select("b", F.col("words").alias("_b")), "b")
    share = F.size(F.array_intersect("_a", "_b")) / F.least(F.size("_a"), F.size("_b"))
    return met.select("a", "b", share.alias("overlap")).where(F.col("overlap") >= least)


def changed_ranges(a: Column, b: Column) -> Column:
    """Ranges (start, end) of places at which two captures of up to some kilobytes differ; a longer one differs to its end."""
    n = F.greatest(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda i: F.substr(a, i + 1, F.lit(1)) != F.substr(b, i + 1, F.lit(1)))

    def ranges(d: Column) -> Column:
        # the places are in order: a range begins and ends where the neighbour is not the next place
        starts = F.filter(d, lambda x, k: F.coalesce(F.get(d, k - 1) != x - 1, F.lit(True)))
        ends = F.filter(d, lambda x, k: F.coalesce(F.get(d, k + 1) != x + 1, F.lit(True)))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))

    return let(differs, ranges)


def capture_history(captures: DataFrame) -> DataFrame:
    """captures (source_id, capture_id, captured_at, file_hash) -> each with the id of the one before it; captures without an id
    are known by the first 16 digits of their hash."""
    named = captures.withColumn("capture_id", F.coalesce("capture_id", F.concat(F.lit("legacy-"), F.substring("file_hash", 1, 16))))
    own = Window.partitionBy("source_id").orderBy("captured_at", "capture_id")
    return named.withColumn("previous_capture_id", F.lag("capture_id").over(own)).withColumn("version", F.row_number().over(own))

"""Operator 11: importance resampling towards a target distribution.

Words come from a table of 256 bytes and bytes.split. The crc32 of a run of words is the seed of the run
that is one word longer, so every feature costs one call whatever its length; a feature's bucket is its crc32 modulo
BUCKETS. A first pass counts the buckets of the documents and of the target texts, in a Counter for each batch,
summed by Spark. The gain of a bucket is how much likelier the target is to have it. A second pass adds up
the gains of each document and a Gumbel draw of its id, so that the documents with the highest scores are a sample without
replacement by weight.

The sample is ranked over the whole corpus without one task that sees it: the rows (no texts) are sorted by ranges of
the score, and a row's rank is its place in its range after the rows of the ranges before. What reaches the driver is
one gain for each bucket and one count for each range.

Defined cases: a null or empty text has no feature, weight 0 and no rank; a null doc_id draws like an empty one and stands last among equal
scores; of rows with equal score and doc_id the one with the higher weight, then with more features, is first; repeated rows each have a rank;
without target texts every gain is that of an absent target; empty tables give an empty result; very long texts are read whole; only doc_id and
text are read, so further columns may bear any name.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import words
from .store import documents, written

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42


def buckets(found: list[bytes], n_buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all runs of one to three words, repeats included."""
    spaced = [b" " + w for w in found]
    one = list(map(crc32, found))
    two = list(map(crc32, spaced[1:], one))
    three = list(map(crc32, spaced[2:], two))
    return np.array(one + two + three, np.int64) % n_buckets


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> dict[int, int]:
    """How often the texts have each bucket; counted in the task first."""

    def run(batches):
        for b in batches:
            seen: Counter[int] = Counter()
            for t in b.column(0):
                seen.update(buckets(words(t.as_py()), n_buckets).tolist())
            yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["bucket", "n"])

    rows = texts.select(texts["text"].cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], n_buckets: int = BUCKETS) -> list[int]:
    """Of each bucket, 1000 times the log of its smoothed share in the target over that in the corpus, rounded down."""
    all_corpus, all_target = float(sum(corpus.values()) + n_buckets), float(sum(target.values()) + n_buckets)
    return [math.floor(1000 * math.log((target.get(k, 0) + 1) * all_corpus / ((corpus.get(k, 0) + 1) * all_target))) for k in range(n_buckets)]


def draw(doc_id: int | None, seed: int = SEED) -> int:
    """1000 times a standard Gumbel variable that only the id decides, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # one number for each bucket

    def run(batches):
        table = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            n, features, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for k, t in enumerate(b.column(1)):
                found = words(t.as_py())
                own = buckets(found, len(table))
                n[k], features[k], weight[k] = len(found), len(own), table[own].sum()
            score = weight + np.array([draw(i, seed) for i in ids], np.int64)
            yield pa.record_batch([b.column(0), *map(pa.array, (n, features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every row of docs, and the rank of those that are drawn: `percent` of 100 of the
    documents with at least `least_words` words."""
    rows = written(scored(docs, gains(bucket_counts(docs), bucket_counts(target)), seed), "scored")
    likely = rows.where(F.col("n_words") >= least_words).drop("n_words")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.desc("weight"), F.desc("n_features")]
    placed = likely.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "placed")
    before, starts = 0, []
    for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["n"]
    ranges = docs.sparkSession.createDataFrame(starts, "part long, before long")  # one row for each range of the sort
    rank = F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", F.shiftright("_at", 33)).join(F.broadcast(ranges), "part").withColumn("rank", F.when(rank <= before * percent // 100, rank))
    names = ["doc_id", "n_features", "weight", "score"]
    rest = rows.where(F.col("n_words") < least_words)
    return ranked.select(*names, "rank").union(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def take_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with all their columns."""
    drawn = resample(docs, target, percent, least_words, seed).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["_drawn"]), "left_semi").select(docs.columns)

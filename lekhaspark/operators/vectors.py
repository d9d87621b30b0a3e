"""Exact vector search of a block of queries against all rows.

Queries are taken in blocks of a fixed number; a block is broadcast, every task multiplies its rows with it and keeps the
best of each query, and only these meet in the shuffle. The rows are read once for each block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block, and digits to which similarities are compared: what decides is the same however rows are dealt.
BLOCK, DIGITS = 1024, 6
#: Rows that a block meets at once: similarities of BLOCK x STEP, 4 MB, whatever the size of a batch.
STEP = 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as one matrix of length one each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    known = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
    n = max(1, -(-known.count() // BLOCK))
    for k in range(n):
        got = known.where(F.pmod(F.xxhash64("q"), F.lit(n)) == k).toArrow()
        if got.num_rows:
            yield got.column("q").to_numpy(), _matrix(got.column("v").combine_chunks())


def _search(rows: DataFrame, key: str, vector: str, ids: np.ndarray, block: np.ndarray, best: int | None, floors: np.ndarray | None) -> DataFrame:
    """(query, key, similarity): of each task the `best` rows of each query, or all that reach the query's floor."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, block, floors))

    def run(batches):
        q, m, low = shared.value
        held_s, held_i = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in (b.slice(k, STEP) for b in batches for k in range(0, b.num_rows, STEP)):
            s = np.round(m @ _matrix(b.column(1)).T, DIGITS) if b.num_rows else np.zeros((len(q), 0))
            i = np.broadcast_to(b.column(0).to_numpy(), s.shape)
            if best is None:
                at, row = np.nonzero(s >= low[:, None])
                yield pa.record_batch([pa.array(q[at]), pa.array(i[at, row]), pa.array(s[at, row])], names=["query", key, "similarity"])
                continue
            held_s, held_i = np.concatenate((held_s, s), axis=1), np.concatenate((held_i, i), axis=1)
            order = np.lexsort((held_i, -held_s), axis=1)[:, :best]
            held_s, held_i = np.take_along_axis(held_s, order, 1), np.take_along_axis(held_i, order, 1)
        if best is not None:
            yield pa.record_batch([pa.array(np.repeat(q, held_s.shape[1])), pa.array(held_i.ravel()), pa.array(held_s.ravel())], names=["query", key, "similarity"])

    known = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector)
    return known.mapInArrow(run, f"query long, {key} long, similarity double")


def _union(parts: list[DataFrame], rows: DataFrame, key: str) -> DataFrame:
    if not parts:
        return rows.sparkSession.createDataFrame([], f"query long, {key} long, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, top: int) -> DataFrame:
    """(query, key, similarity, rank): the `top` rows of each query by cosine similarity, then by key. Rows and queries are
    tables with the same key and vector columns; null vectors take no part, a vector of zeros is similar to nothing."""
    found = _union([_search(rows, key, vector, ids, block, top, None) for ids, block in _blocks(queries, key, vector)], rows, key)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def above_floor(rows: DataFrame, queries: DataFrame, key: str, vector: str, least: float, below_best: float) -> DataFrame:
    """(query, key, similarity): all rows at `least` or more and no more than `below_best` under the query's best row."""
    parts = []
    for ids, block in _blocks(queries, key, vector):
        best = {r["query"]: r["m"] for r in _search(rows, key, vector, ids, block, 1, None).groupBy("query").agg(F.max("similarity").alias("m")).collect()}
        floors = np.array([max(least, round(best.get(int(q), 0.0) - below_best, DIGITS)) for q in ids])
        parts.append(_search(rows, key, vector, ids, block, None, floors))
    return _union(parts, rows, key)

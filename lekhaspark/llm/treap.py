"""Operator 12: ranked lexical search by a K2-treap over the grid of terms and documents.

Rows of the grid are the terms of the items, columns the documents of a slice of texts, and a cell holds the impact of a
term in a document. The grid is halved both ways again and again; only quarters that hold an impact are
stored, level by level in the order of their interleaved coordinates, each with the highest impact inside it, a mask of
its quarters and where the first of them stands. Rows stand in the order of their weights and columns by their
main term and length, so that neighbours have like impacts.

An item is a set of rows. Its search starts with the range of all columns, where each row is in the
root cell. A range is opened by following each row's path into the cell of either half of the columns; rows whose cell is not stored leave.
The sum of the impacts of the cells bounds what any document of the range can score, and at one column it is
its score. The ranges with the highest bounds are opened first, a number of them for each item and all items of a step together,
until no bound exceeds the item's last place (or equals it with a smaller doc_id). The places go from slice to
slice within a task, then the places of all tasks are ranked. Results are exact, whatever the slices.

Statistics (documents, words, documents with each term) come from a pass of their own over all documents; only terms of items are counted.
At most PART_WORDS different words of items are broadcast at once; more items are searched in parts, and the documents are read
twice for each part.

Defined cases: null, empty or wordless texts hold no term and are never returned; items without a term that any document holds
have no rows in the result; rows that share an item_id are one item with the terms of all of them, and items without an id are left out;
repeated rows of documents are documents of their own, and rows without a doc_id count in the statistics but cannot be returned; of equal scores
the smaller doc_id is first; empty tables give an empty result; very long texts are read whole; only doc_id, item_id and text are read, so further columns may
bear any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import words
from .store import documents, forget, written

TOP = 10
#: The most different words of items that are broadcast at once (one item at least).
PART_WORDS = 1 << 20
#: Bytes of text in one grid (one document at least).
SLICE_BYTES = 4 << 20
#: Ranges of an item that are opened in one step, and rows of items that are searched together.
WIDTH = 128
ROWS = 4096
#: Groups that the places of all tasks are ranked in first.
GROUPS = 64

#: How many of the quarters before q a mask has.
_BEFORE = np.array([[(m & ((1 << q) - 1)).bit_count() for q in range(4)] for m in range(16)], np.int64)
_NONE = np.iinfo(np.int64).max


def _spread(x: np.ndarray) -> np.ndarray:
    """A zero bit before each bit of x (under 2**31)."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class Treap:
    """The stored cells of a grid: `top` their highest impacts, `mask` which quarters they have, `first` where these stand."""

    def __init__(self, row: np.ndarray, col: np.ndarray, impact: np.ndarray, n_rows: int, ids: np.ndarray):
        self.height = max(1, (max(n_rows, len(ids)) - 1).bit_length())
        code = _spread(row) << np.uint64(1) | _spread(col)
        by = np.argsort(code)
        code, top = code[by], impact[by]
        tops, masks, firsts = [top], [np.zeros(len(top), np.int64)], [np.zeros(len(top), np.int64)]
        for _ in range(self.height):
            up = code >> np.uint64(2)
            first = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
            masks.append(np.bitwise_or.reduceat(1 << (code & np.uint64(3)).astype(np.int64), first))
            top = np.maximum.reduceat(top, first)
            firsts.append(first)
            tops.append(top)
            code = up[first]
        # numbered from the root down; the cells of a level follow those of the level above
        sizes = [len(t) for t in reversed(tops)]
        starts = np.cumsum(sizes)
        self.top, self.mask = np.concatenate(tops[::-1]), np.concatenate(masks[::-1])
        self.first = np.concatenate([f + s for f, s in zip(firsts[::-1], starts)])
        # the smallest id of each range of columns, by level
        low = np.full(1 << self.height, _NONE)
        low[: len(ids)] = ids
        self.low = [low]
        while len(low) > 1:
            low = np.minimum(low[::2], low[1::2])
            self.low.append(low)
        self.low.reverse()
        self.low_at = np.cumsum([0] + [len(x) for x in self.low])
        self.low = np.concatenate(self.low)

    def descend(self, rows: list[np.ndarray], places: "Places", owner: np.ndarray) -> None:
        """Searches the items with these rows; places.score and places.id of item owner[k] get what is found for rows[k]."""
        item, level, col = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        size = np.array([len(r) for r in rows])
        row = np.concatenate(rows)
        cell = np.zeros(len(row), np.int64)
        bound = size * self.top[0]
        while len(item):
            # the highest bounds of each item
            by = np.lexsort((-bound, item))
            nth = np.arange(len(by)) - np.searchsorted(item[by], item[by])
            chosen = np.zeros(len(item), bool)
            chosen[by[nth < WIDTH]] = True
            of = np.repeat(np.arange(len(item)), size)
            own = chosen[of]
            found = self._open(item[chosen], level[chosen], col[chosen], size[chosen], row[own], cell[own])
            item, level, col, size, bound = (x[~chosen] for x in (item, level, col, size, bound))
            row, cell = row[~own], cell[~own]
            leaf = found[1] == self.height
            if leaf.any():
                places.add(owner[found[0][leaf]], self.low[self.low_at[self.height] + found[2][leaf]], found[4][leaf])
            item, level, col, size, bound = (np.concatenate(p) for p in zip((item, level, col, size, bound), found[:5]))
            row, cell = np.concatenate((row, found[5])), np.concatenate((cell, found[6]))
            best, last = places.least[owner[item]], places.last[owner[item]]
            low = self.low[self.low_at[level] + col]
            stay = (level < self.height) & ((bound > best) | (bound == best) & (low < last))
            row, cell = (x[np.repeat(stay, size)] for x in (row, cell))
            item, level, col, size, bound = (x[stay] for x in (item, level, col, size, bound))

    def _open(self, item, level, col, size, row, cell):
        """Both halves of ranges: (item, level, col, size, bound, row, cell) of those that hold any row."""
        of = np.repeat(np.arange(len(item)), size)
        upper = (row >> (self.height - 1 - level)[of] & 1) << 1
        mask, first = self.mask[cell], self.first[cell]
        halves = []
        for half in (0, 1):
            quarter = upper | half
            held = mask >> quarter & 1 == 1
            below = (first + _BEFORE[mask, quarter])[held]
            n = np.bincount(of[held], minlength=len(item))
            # sums of integers far under 2**53 are exact in doubles
            bound = np.bincount(of[held], self.top[below], len(item)).astype(np.int64)
            some = n > 0
            halves.append((item[some], level[some] + 1, 2 * col[some] + half, n[some], bound[some], row[held], below))
        return [np.concatenate(p) for p in zip(*halves)]


class Places:
    """The best documents of each item so far: scores and ids, the last place's score and id (0 and the highest while there is room)."""

    def __init__(self, n_items: int, top: int):
        self.n, self.top = n_items, top
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least, self.last = np.zeros(n_items, np.int64), np.full(n_items, np.iinfo(np.int64).min)

    def add(self, item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        item, ids, score = (np.concatenate(p) for p in ((self.item, item), (self.id, ids), (self.score, score)))
        by = np.lexsort((ids, -score, item))
        item, ids, score = item[by], ids[by], score[by]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        stay = (nth < self.top) & (score > 0)
        self.item, self.id, self.score, nth = (x[stay] for x in (item, ids, score, nth))
        full = nth == self.top - 1
        self.least[self.item[full]], self.last[self.item[full]] = self.score[full], self.id[full]


def _vocabulary(benchmark: DataFrame):
    """Parts of the benchmark, each ({term: number}, [item_id], [numbers of the item's terms]) of about PART_WORDS words."""

    def terms(batches):
        for b in batches:
            found = [sorted(set(words(t.as_py()))) for t in b.column(1)]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found])))
            yield pa.record_batch([ids, pa.array([w for f in found for w in f], pa.binary())], names=["item_id", "term"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    rows = written(items.mapInArrow(terms, "item_id long, term binary").distinct(), "item_terms")
    n_parts = max(1, -(-rows.count() // PART_WORDS))
    for k in range(n_parts):
        known: dict[bytes, int] = {}
        by_item: dict[int, list[int]] = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == k).collect():
            by_item.setdefault(r["item_id"], []).append(known.setdefault(bytes(r["term"]), len(known)))
        if known:
            yield known, list(by_item), [np.array(sorted(t)) for t in by_item.values()]
    forget(rows)


def _statistics(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a word, words of all documents, and documents with each known term."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        get, df, n, total = shared.value.get, np.zeros(len(shared.value), np.int64), 0, 0
        for b in batches:
            for t in b.column(1):
                found = words(t.as_py())
                n += len(found) > 0
                total += len(found)
                held = set(map(get, found))
                held.discard(None)
                df[list(held)] += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate((at, [-1, -2]))), pa.array(np.concatenate((df[at], [n, total])).astype(np.int64))], names=["term", "n"])

    rows = documents(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in rows.collect()}
    shared.unpersist()
    return got.pop(-1, 0), got.pop(-2, 0), np.array([got.get(k, 0) for k in range(len(known))], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _slices(batches, limit: int):
    """Lists of (doc_id, text) of about `limit` characters."""
    held, size = [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            text = t.as_py()
            if held and size + len(text) > limit:
                yield held
                held, size = [], 0
            held.append((i, text))
            size += len(text)
    if held:
        yield held


def rank(docs: DataFrame, benchmark: DataFrame, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    base = documents(docs)
    for known, item_ids, rows in _vocabulary(benchmark):
        n_docs, n_words, df = _statistics(docs, known)
        w = weights(n_docs, df)
        # heavy terms first; rows of the grid are in this order
        by = np.lexsort((np.arange(len(w)), -w))
        row_of = np.empty(len(w), np.int64)
        row_of[by] = np.arange(len(w))
        held = [row_of[r[(w[r] > 0) & (df[r] > 0)]] for r in rows]
        asked = [k for k, r in enumerate(held) if len(r)]
        if not asked:
            continue
        model = {t: int(row_of[k]) for t, k in known.items()}, w[by], [held[k] for k in asked], np.array([item_ids[k] for k in asked])
        shared = spark.sparkContext.broadcast(model)

        def search(batches, shared=shared, n_docs=n_docs, n_words=n_words):
            known, weight, rows, ids = shared.value
            places = Places(len(rows), top)
            for part in _slices(batches, slice_bytes):
                grid = _grid(part, known.get, weight, n_docs, n_words)
                if grid is None:
                    continue
                lo = 0
                while lo < len(rows):
                    hi, n = lo + 1, len(rows[lo])
                    while hi < len(rows) and n + len(rows[hi]) <= ROWS:
                        n += len(rows[hi])
                        hi += 1
                    grid.descend(rows[lo:hi], places, np.arange(lo, hi))
                    lo = hi
            yield pa.record_batch([pa.array(ids[places.item]), pa.array(places.id), pa.array(places.score)], names=["item_id", "doc_id", "score"])

        out = out.union(base.mapInArrow(search, "item_id long, doc_id long, score long"))
    # first within groups of tasks, so that no task ranks the places of all tasks
    order = [F.desc("score"), "doc_id"]
    out = out.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    for keys in (["item_id", "_group"], ["item_id"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")


def _grid(part: list[tuple[int | None, str]], get, weight: np.ndarray, n_docs: int, n_words: int) -> Treap | None:
    """The grid of a slice of documents; those without an id or a known term have no column."""
    rows, times, ids, first, scale = [], [], [], [], []
    for i, text in part:
        found = words(text)
        own = np.array([t for t in map(get, found) if t is not None], np.int64)
        if i is None or not len(own):
            continue
        row, tf = np.unique(own, return_counts=True)
        rows.append(row)
        times.append(tf)
        ids.append(i)
        first.append(int(row[tf.argmax()]))
        scale.append(10 + 90 * len(found) * n_docs // n_words)
    if not rows:
        return None
    by = np.lexsort((ids, scale, first))
    size = np.array([len(rows[k]) for k in by])
    row, tf = np.concatenate([rows[k] for k in by]), np.concatenate([times[k] for k in by]).astype(np.int64)
    m = np.repeat(np.array(scale, np.int64)[by], size)
    impact = weight[row] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
    some = impact > 0
    if not some.any():
        return None
    return Treap(row[some], np.repeat(np.arange(len(by)), size)[some], impact[some], len(weight), np.array(ids, np.int64)[by])


def sql(top: int = TOP) -> str:
    """The same in DuckDB SQL."""
    cut = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH i AS (SELECT DISTINCT item_id, unnest({cut}) AS term FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT doc_id, row_number() OVER () AS k, {cut} AS words FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
p AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(words) AS term FROM d) x WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
h AS (SELECT k, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.words)::BIGINT * s.n) // s.l))) AS impact FROM p JOIN d USING (k) JOIN w USING (term), s),
r AS (SELECT item_id, k, sum(impact)::BIGINT AS score FROM i JOIN h USING (term) GROUP BY ALL HAVING score > 0),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r JOIN d USING (k) WHERE doc_id IS NOT NULL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {int(top)}"""

"""Operator 13: document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs: at line ends, after sentences, and where the last bytes before a space say so, so that
a long line has several. Each paragraph has a 64-bit digest, and a repeated one a digest for each time. A sketch holds for each of
its cells how many digests fell there, and the exclusive or of the digests and of their check values; a digest falls into one cell
of each third. The fingerprint is the sketch of CELLS cells, the number of paragraphs and a hash of the whole text.

Sketches of two versions are subtracted cell by cell: what both have is gone. A cell with one digest left gives it
away; taken out of its other cells it frees more of them (peeling). If cells remain, the sketches were too small for the
difference and both are made GROWTH times larger. Likeness is the share of common paragraphs among all
paragraphs of either text, by the numbers of paragraphs and of recovered digests. Many pairs of texts are peeled together, in arrays.

`next_versions` pairs every document with the next one by doc_id. The texts move once, to ranges of the order; the first row of a range goes
to the end of the range before as well, so no range waits for another. The limits of the ranges come from ids and hashes only, one for each range.

Defined cases: a null text is an empty one; two texts without any paragraph are alike (1.0); equal texts have equal fingerprints, and texts
of the same paragraphs in another order differ in the hash alone; rows without a doc_id stand after all others; rows that share one stand in the order
of the hash of their text; many equal rows (a third of all, say) are spread over the tasks, each followed by its equal; a single row follows
itself; an empty table gives an empty result; very long texts are read whole; only doc_id and text are read, so further columns may bear any name.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import documents, partitions

CELLS = 24
GROWTH = 4
#: Digests that a sketch may have for each cell it would need at least; beyond it the digests themselves are compared.
MOST_CELLS = 64
#: One space in so many ends a paragraph without a line or sentence end.
CUT_ONE_IN = 8
BATCH_CHARS = 2 << 20


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of the paragraphs of all texts, by text."""
    import xxhash

    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    whole = b"".join(raw)
    if not whole:
        return np.zeros(0, np.int64), np.zeros(0, B.U)
    data = np.frombuffer(b"\0" * 4 + whole, np.uint8)
    # the four bytes before each byte, as a number
    last = data[:-4].astype(np.uint64) | data[1:-3].astype(np.uint64) << B.U(8) | data[2:-2].astype(np.uint64) << B.U(16) | data[3:-1].astype(np.uint64) << B.U(24)
    here, before = data[4:], data[3:-1]
    at = np.flatnonzero(here == 32)
    # only bytes of the same text decide
    at = at[at - off[np.searchsorted(off, at, "right") - 1] >= 4]
    ended = (before[at] == 46) | (before[at] == 33) | (before[at] == 63) | (B.mix(last[at], 5) % B.U(CUT_ONE_IN) == 0)
    cut = np.concatenate((np.flatnonzero(here == 10), at[ended])) + 1
    ends = B.distinct(np.concatenate((cut, off[1:])))
    ends = ends[ends > 0]
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh3_64_intdigest
    keys = np.array([digest(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], B.U)
    of = np.searchsorted(off, starts, "right") - 1
    # a paragraph that a text has again has another digest each time
    by = np.lexsort((keys, of))
    of, keys = of[by], keys[by]
    same = np.concatenate(([False], (of[1:] == of[:-1]) & (keys[1:] == keys[:-1])))
    nth = np.arange(len(keys)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
    return of, np.where(nth > 0, B.mix(keys + B.mix(nth.astype(B.U), 21), 22), keys)


def _check(keys: np.ndarray) -> np.ndarray:
    return B.mix(keys, 77) >> B.U(32)


def _cells(of: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, in the tables that stand one after another."""
    third = cells // 3
    return np.stack([of * cells + j * third + (B.mix(keys, 31 + j) % B.U(third)).astype(np.int64) for j in range(3)])


def sketches(of: np.ndarray, keys: np.ndarray, sign: np.ndarray | None, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, digests, checks) of the cells of n sketches; sign -1 subtracts."""
    at = _cells(of, keys, cells)
    count = np.zeros(n * cells, np.int64)
    key, check = np.zeros(n * cells, B.U), np.zeros(n * cells, B.U)
    if len(keys):
        checks = _check(keys)
        for a in at:
            count += np.bincount(a, sign, n * cells).astype(np.int64)
            np.bitwise_xor.at(key, a, keys)
            np.bitwise_xor.at(check, a, checks)
    return count, key, check


def _peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sketch number, digest, sign) of what comes out of n sketches, and which of them are empty then."""
    out_of, out_key, out_sign = [], [], []
    while True:
        pure = np.flatnonzero(np.abs(count) == 1)
        pure = pure[_check(key[pure]) == check[pure]]
        if not len(pure):
            break
        of, keys, sign = pure // cells, key[pure], count[pure]
        # once, though several of its cells may show it
        by = np.lexsort((keys, of))
        once = np.concatenate(([True], (of[by][1:] != of[by][:-1]) | (keys[by][1:] != keys[by][:-1])))
        of, keys, sign = of[by][once], keys[by][once], sign[by][once]
        checks = _check(keys)
        for a in _cells(of, keys, cells):
            np.subtract.at(count, a, sign)
            np.bitwise_xor.at(key, a, keys)
            np.bitwise_xor.at(check, a, checks)
        out_of.append(of)
        out_key.append(keys)
        out_sign.append(sign)
        if sum(map(len, out_of)) > 2 * n * cells:  # a digest that goes in and out: these sketches are too small
            break
    empty = ~((count != 0) | (key != 0) | (check != 0)).reshape(n, cells).any(axis=1)
    if not out_of:
        return np.zeros(0, np.int64), np.zeros(0, B.U), np.zeros(0, np.int64), empty
    return np.concatenate(out_of), np.concatenate(out_key), np.concatenate(out_sign), empty


def differences(of: np.ndarray, keys: np.ndarray, n_texts: int, old: np.ndarray, new: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each pair of texts (old[k], new[k]): the digests that only the old one has, only the new one has, and the cells it took."""
    ptr = np.searchsorted(of, np.arange(n_texts + 1))
    size = np.diff(ptr)
    gone, come = [np.zeros(0, B.U)] * len(old), [np.zeros(0, B.U)] * len(old)
    took = np.full(len(old), CELLS)
    todo, cells = np.arange(len(old)), CELLS
    while len(todo):
        both = np.concatenate((old[todo], new[todo]))
        n = size[both]
        place = np.repeat(ptr[both] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair = np.repeat(np.tile(np.arange(len(todo)), 2), n)
        sign = np.repeat(np.repeat([1, -1], len(todo)), n)
        p, k, s, empty = _peel(*sketches(pair, keys[place], sign, len(todo), cells), len(todo), cells)
        # the tables of one step have a bounded number of cells for each digest
        beyond = cells > MOST_CELLS * (n[: len(todo)] + n[len(todo) :] + 1)
        for which in np.flatnonzero(~empty & beyond):
            a, b = (keys[ptr[x[todo[which]]] : ptr[x[todo[which]] + 1]] for x in (old, new))
            gone[todo[which]], come[todo[which]] = np.setdiff1d(a, b), np.setdiff1d(b, a)
        by = np.argsort(p, kind="stable")
        p, k, s = p[by], k[by], s[by]
        cut = np.searchsorted(p, np.arange(len(todo) + 1))
        for which in np.flatnonzero(empty):
            own = slice(cut[which], cut[which + 1])
            gone[todo[which]], come[todo[which]] = k[own][s[own] > 0], k[own][s[own] < 0]
        took[todo] = cells
        todo = todo[~empty & ~beyond]
        cells *= GROWTH
    return gone, come, took


def _likeness(size: np.ndarray, old: np.ndarray, new: np.ndarray, gone: list[np.ndarray], come: list[np.ndarray]) -> np.ndarray:
    total, apart = size[old] + size[new], np.array([len(a) + len(b) for a, b in zip(gone, come)])
    return np.where(total > 0, (total - apart) / np.maximum(1, total + apart), 1.0)


def fingerprint_strings(texts: list[str], of: np.ndarray, keys: np.ndarray) -> list[str]:
    """The sketches of CELLS cells in base64, after the number of paragraphs and the hash of the whole text."""
    import xxhash

    count, key, check = (x.reshape(len(texts), CELLS) for x in sketches(of, keys, None, len(texts), CELLS))
    size = np.bincount(of, minlength=len(texts))
    out = []
    for i, t in enumerate(texts):
        head = np.array([size[i], xxhash.xxh3_64_intdigest(t.encode())], "<u8").tobytes()
        out.append(base64.b64encode(head + count[i].astype("<u4").tobytes() + key[i].astype("<u8").tobytes() + check[i].astype("<u4").tobytes()).decode())
    return out


def _batches(rows, limit: int = BATCH_CHARS):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, fingerprint of every row."""

    def run(batches):
        for part in _batches((i, t.as_py()) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1))):
            texts = [t for _, t in part]
            of, keys = paragraphs(texts)
            found = fingerprint_strings(texts, of, keys)
            yield pa.record_batch([pa.array([i for i, _ in part], pa.int64()), pa.array(np.bincount(of, minlength=len(texts))), pa.array(found)], names=["doc_id", "n_paragraphs", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, n_paragraphs long, fingerprint string")


def changes(versions: DataFrame) -> DataFrame:
    """(id, old, new) -> id, near, removed, added, cells: the digests of paragraphs that only one version has, recovered from sketches of so many cells."""

    def run(batches):
        for part in _batches((r["id"], r["old"] or "", r["new"] or "") for b in batches for r in b.to_pylist()):
            texts = [x for _, old, new in part for x in (old, new)]
            of, keys = paragraphs(texts)
            old = np.arange(0, len(texts), 2)
            gone, come, cells = differences(of, keys, len(texts), old, old + 1)
            near = _likeness(np.bincount(of, minlength=len(texts)), old, old + 1, gone, come)
            digests = [pa.array([x.view(np.int64).tolist() for x in each], pa.list_(pa.int64())) for each in (gone, come)]
            yield pa.record_batch([pa.array([i for i, _, _ in part], pa.int64()), pa.array(near), *digests, pa.array(cells)], names=["id", "near", "removed", "added", "cells"])

    rows = versions.select(F.col("id").cast("long").alias("id"), F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"))
    return rows.mapInArrow(run, "id long, near double, removed array<long>, added array<long>, cells long")


def half_edited(text: str, following: str) -> str:
    """The last half of a text replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def next_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row and its successor by doc_id."""
    rows = documents(docs).withColumn("h", F.xxhash64("text"))
    n = partitions(rows)
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    groups = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    ranged = groups.repartitionByRange(n, *order).groupBy(F.spark_partition_id()).agg(F.min(key).alias("first"), F.sum("n").alias("n")).collect()
    cuts = sorted(tuple(r["first"]) for r in ranged)  # one for each range
    # equal rows that would fill a range by themselves; there are fewer of these than ranges
    most = max(1, sum(r["n"] for r in ranged) // n)
    hot = {tuple(r["k"]) for r in groups.where(F.col("n") > most).select(key.alias("k")).collect()}

    def place(batches):
        turn = 0
        for b in batches:
            bucket, kind, at = [], [], []
            for k, (i, h) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                own = i is None, i or 0, h
                if own in hot:
                    turn += 1
                    if turn % n != 1 % n:
                        # its successor is its equal
                        bucket.append(turn % len(cuts))
                        kind.append(0)
                        at.append(k)
                        continue
                mine = bisect_right(cuts, own) - 1
                bucket.append(mine)
                kind.append(1)
                at.append(k)
                if cuts[mine] == own:
                    bucket.append((mine - 1) % len(cuts))
                    kind.append(2)
                    at.append(k)
            yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *b.take(pa.array(at, pa.int64())).columns], names=["bucket", "kind", "doc_id", "text", "h"])

    def pairs(batches):
        waiting = None
        for b in batches:
            for bucket, kind, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if kind == 0:
                    yield i, (t := t.as_py()), t
                    continue
                if kind == 2 and waiting is None:
                    continue
                t = t.as_py()
                if waiting is not None:
                    yield *waiting, t
                waiting = (i, t) if kind == 1 else None

    def compare(batches):
        for part in _batches(pairs(batches)):
            names: dict[str, int] = {}
            own, edited, after = (np.array([names.setdefault(x, len(names)) for x in each]) for each in ([t for _, t, _ in part], [half_edited(t, u) for _, t, u in part], [u for _, _, u in part]))
            texts = list(names)
            of, keys = paragraphs(texts)
            size = np.bincount(of, minlength=len(texts))
            found = np.array(fingerprint_strings(texts, of, keys), object)
            first, second = np.concatenate((own, own)), np.concatenate((edited, after))
            near = _likeness(size, first, second, *differences(of, keys, len(texts), first, second)[:2])
            sha = [hashlib.sha256(texts[e].encode()).hexdigest() for e in edited.tolist()]
            yield pa.record_batch(
                [pa.array([i for i, _, _ in part], pa.int64()), pa.array([len(t) for _, t, _ in part], pa.int64()), pa.array(sha), pa.array(found[own]), pa.array(found[edited]), pa.array(near[: len(part)]), pa.array(near[len(part) :])],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    placed = rows.mapInArrow(place, "bucket int, kind int, doc_id long, text string, h long").repartitionById(n, F.col("bucket"))
    placed = placed.sortWithinPartitions("bucket", "kind", *order)
    return placed.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

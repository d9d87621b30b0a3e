"""Operator 5: removal of long byte strings that stand in an earlier document.

A suffix that starts at an anchor - the position whose next GRAM bytes hash lowest
in some window of LENGTH bytes - stands for the suffixes around it: every string of
LENGTH bytes contains an anchor, and equal strings contain the same. Prefix
polynomial hashes give the hash of any stretch of a document in constant time, so
suffixes are compared by hashes of their beginnings, first the GRAM bytes, then all that
a string of LENGTH bytes around the anchor can reach, and only where these
differ string by string:

1. anchored suffixes are dealt by the hash of their GRAM bytes and sorted by
   (GRAM bytes, context, doc_id), each range in its own task. A suffix whose whole
   context stands in a smaller document is settled: all of its context goes. A
   beginning that two documents hold with different contexts is open.
2. a string of LENGTH bytes around an anchor reaches at least half of what is beyond
   the gram to the left or to the right. For open suffixes the gram with such a half is
   compared, on either side; a side that no other document shares is given up.
3. around what is left - the ends of common passages - the strings of LENGTH
   bytes themselves are dealt by hash and sorted. A string that stands in a smaller
   document goes.

Records that are equal within a slice leave it once, under their least document: what every
document holds comes to the task of its key once for each slice, not once for each document.

The texts are written once, in slices, as a table bucketed by slice, and the answers
are routed to the slices, so texts are never shuffled. Records are packed arrays
sorted in the tasks. Whatever the polynomial hash finds equal is verified by a second hash of 64 bits,
made of the bytes themselves and not of the polynomial: of the context in step 1, of the string in step 3.

Defined cases: a null or short text loses nothing; rows with one doc_id are not
smaller than each other, so they lose nothing to each other; a row with a null
doc_id neither loses nor takes away; a document longer than a slice is one slice; an empty table gives an empty
result; only doc_id and text are read, so further columns may bear any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import documents, forget, fresh_path, partitions, remove, written

LENGTH = 50
GRAM = 16
SLICE = 4 << 20
#: Bytes of text whose records make a bucket, at most where there are fewer shuffle partitions than that takes.
_BUCKET_BYTES = 32 << 20


def _spread(values: np.ndarray, of: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Indices of the records of each bucket, in order."""
    b = ((of >> B.U(32)) % B.U(buckets)).astype(np.int64)
    by = np.argsort(b, kind="stable")
    ends = np.searchsorted(b[by], np.arange(buckets + 1))
    return [by[ends[i] : ends[i + 1]] for i in range(buckets)]


def _words(data: np.ndarray) -> np.ndarray:
    """For each position the eight bytes from there on as a number, zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded.tobytes(), 0, (1,))


def _check_hash(words: np.ndarray, first: np.ndarray, size: np.ndarray | int, longest: int) -> np.ndarray:
    """A hash of the bytes first..first+size that has nothing in common with the polynomial: eight bytes at a time, each word
    mixed with its place, then summed and mixed. It verifies what the polynomial finds equal."""
    out = B.mix(np.broadcast_to(np.asarray(size), first.shape).astype(B.U), 41)
    for k in range(0, longest, 8):
        left = size - k
        w = words[np.minimum(first + k, len(words) - 1)]
        short = np.clip(8 - left, 0, 8)
        if np.any(short):
            w = np.where(short >= 8, B.U(0), w & (B.U(0xFFFFFFFFFFFFFFFF) >> (8 * np.minimum(short, 7)).astype(B.U)))
        out = out + B.mix(w, 43 + k)
    return B.mix(out, 42)


class _Slice:
    """Bytes, rows, prefix hashes and anchors of one slice; anchors: the gaps that an earlier step has found."""

    def __init__(self, table: pa.Table, length: int, gaps: bytes | None = None):
        table = table.sort_by("r")
        self.length = length
        self.ids = table.column("doc_id").combine_chunks()
        self.data, self.off = B.utf8(table.column("text"))
        self.hash = B.prefix_hash(self.data)
        self.words = _words(self.data)
        self.reach = length - GRAM
        self.anchors = self._anchors() if gaps is None else np.cumsum(np.frombuffer(gaps, np.uint32).astype(np.int64))
        self.keys = B.mix(B.span_hash(self.hash, self.anchors, self.anchors + GRAM), 21)
        self.row = np.searchsorted(self.off, self.anchors, "right") - 1
        self.first = np.maximum(self.anchors - self.reach, self.off[self.row])
        self.last = np.minimum(self.anchors + length, self.off[self.row + 1])
        self.docs = self.ids.fill_null(0).to_numpy()

    def _anchors(self) -> np.ndarray:
        n, length = len(self.data), self.length
        alive = np.zeros(max(0, n - length + 1), bool)
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        for lo, hi, ok in zip(self.off[:-1].tolist(), self.off[1:].tolist(), known.tolist()):
            if ok and hi - lo >= length:
                alive[lo : hi - length + 1] = True
        if not alive.any():
            return np.zeros(0, np.int64)
        at = np.arange(n - GRAM + 1)
        gram = B.mix(B.span_hash(self.hash, at, at + GRAM), 21)
        low = (gram & B.U(0xFFFFFFFF00000000)) | at.astype(B.U)
        width, need = 1, length - GRAM + 1
        while width * 2 <= need:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < need:
            low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
        return B.distinct((low[: len(alive)][alive] & B.U(0xFFFFFFFF))).astype(np.int64)

    def gaps(self) -> bytes:
        return np.diff(self.anchors, prepend=0).astype(np.uint32).tobytes()

    def contexts(self) -> np.ndarray:
        """The bytes around an anchor that strings of the length can reach, and where the anchor stands in them."""
        inside = B.mix((self.anchors - self.first).astype(B.U), 22)
        return B.mix(_check_hash(self.words, self.first, self.last - self.first, self.reach + self.length) ^ inside, 23)

    def suffixes(self) -> tuple["_Distinct", np.ndarray]:
        second = self.contexts()
        return _Distinct(self.docs[self.row], self.keys, second), second

    def halves(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in anchors, side, hash) of the gram with half of its reach to the left (0) or right (1), where the row has it."""
        half, a = (self.reach + 1) // 2, self.anchors[anchors]
        left, right = np.flatnonzero(a - half >= self.off[self.row[anchors]]), np.flatnonzero(a + GRAM + half <= self.last[anchors])
        h = [B.mix(B.span_hash(self.hash, a[left] - half, a[left] + GRAM), 27), B.mix(B.span_hash(self.hash, a[right], a[right] + GRAM + half), 28)]
        return np.concatenate((left, right)), np.repeat([0, 1], [len(left), len(right)]), np.concatenate(h)

    def strings(self, anchors: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Starts of the strings of the length that contain one of these anchors' grams and reach far to its side."""
        half = (self.reach + 1) // 2
        a = self.anchors[anchors]
        lo = np.where(side == 0, self.first[anchors], np.maximum(self.first[anchors], a - (self.reach - half)))
        hi = np.minimum(np.where(side == 0, a - half, a), self.last[anchors] - self.length)
        size = np.maximum(0, hi - lo + 1)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return B.distinct((np.repeat(lo - (ends - size), size) + np.arange(total)).astype(B.U)).astype(np.int64)

    def names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = B.span_hash(self.hash, starts, starts + self.length)
        return B.mix(h, 24), _check_hash(self.words, starts, self.length, self.length)


class _Distinct:
    """Equal records of a slice as one: that of the least document stands for them, so that what every document holds
    leaves a slice once."""

    def __init__(self, docs: np.ndarray, *keys: np.ndarray):
        one = keys[0] if len(keys) == 1 else keys[0] ^ B.mix(keys[1], 44)
        by = np.argsort(one, kind="stable")
        start = _first_of(one[by])
        size = np.diff(np.append(start, len(by)))
        self.of = np.empty(len(by), np.int64)
        self.of[by] = np.repeat(np.arange(len(start)), size)
        least = np.minimum.reduceat(docs[by], start) if len(start) else docs[:0]
        most = np.maximum.reduceat(docs[by], start) if len(start) else docs[:0]
        #: whether a smaller document of this slice holds the record
        self.later = docs > least[self.of]
        self.least, self.most = least, most
        #: one record of each group, of its least document
        place = np.full(len(start), len(by), np.int64)
        np.minimum.at(place, self.of[~self.later], np.flatnonzero(~self.later))
        self.one = place

    def spread(self, marked: np.ndarray) -> np.ndarray:
        """The records of the least documents whose groups are marked."""
        flags = np.zeros(len(self.one), bool)
        flags[marked] = True
        return np.flatnonzero(flags[self.of] & ~self.later)


_RECORDS = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("keys", pa.binary()), ("second", pa.binary()), ("docs", pa.binary())])
_RECORDS_DDL = "bucket int, g long, keys binary, second binary, docs binary"
_ANSWERS = pa.schema([("g", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("at", pa.binary())])
_ANSWERS_DDL = "g long, bucket int, kind int, at binary"


def _packed(g: int, keys: np.ndarray, second: np.ndarray | None, of: np.ndarray, buckets: int, gaps: bytes | None = None) -> pa.Table:
    """Records by bucket: 8 bytes of key, 8 of the second hash, and an index into the distinct doc_ids that head `docs`.
    gaps: the anchors of the slice, in a bucket of its own that is only passed on."""
    cols: list[list] = [[] for _ in _RECORDS]
    if gaps is not None:
        for c, v in zip(cols, (-1 - g % buckets, g, gaps, b"", b"")):
            c.append(v)
    for b, pick in enumerate(_spread(keys, keys, buckets)):
        if len(pick):
            docs, index = np.unique(of[pick], return_inverse=True)
            kind = np.uint16 if len(docs) <= 1 << 16 else np.uint32
            head = np.array([len(docs), np.dtype(kind).itemsize], np.int64).tobytes()
            short = b"" if second is None else second[pick].tobytes()
            for c, v in zip(cols, (b, g, keys[pick].tobytes(), short, head + docs.astype(np.int64).tobytes() + index.astype(kind).tobytes())):
                c.append(v)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _RECORDS)], schema=_RECORDS)


def _docs(raw: bytes) -> np.ndarray:
    n, size = np.frombuffer(raw, np.int64, 2)
    ids = np.frombuffer(raw, np.int64, n, 16)
    return ids[np.frombuffer(raw, np.uint16 if size == 2 else np.uint32, -1, 16 + 8 * int(n))]


class _Block:
    """The records of one bucket, and where they came from."""

    def __init__(self, bucket: int, rows: list):
        self.bucket, self.gs = bucket, [r[0] for r in rows]
        if bucket < 0:
            self.gaps = [r[1] for r in rows]
            return
        size = np.array([len(r[1]) // 8 for r in rows])
        self.keys = np.concatenate([np.frombuffer(r[1], B.U) for r in rows])
        self.second = np.concatenate([np.frombuffer(r[2], B.U) if r[2] else np.zeros(n, B.U) for r, n in zip(rows, size.tolist())])
        self.docs = np.concatenate([_docs(r[3]) for r in rows])
        self.block, self.start = np.repeat(np.arange(len(rows)), size), np.cumsum(size) - size

    def passed_on(self) -> pa.RecordBatch:
        cols = (self.gs, [self.bucket] * len(self.gs), [0] * len(self.gs), self.gaps)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ANSWERS)], schema=_ANSWERS)

    def answer(self, marked: np.ndarray, kind: int) -> pa.RecordBatch:
        """The places of the marked records in their blocks, to their slices."""
        pick = np.flatnonzero(marked)
        cut = np.searchsorted(self.block[pick], np.arange(len(self.gs) + 1))
        rows = [(g, self.bucket, kind, (pick[cut[i] : cut[i + 1]] - self.start[i]).astype(np.uint32).tobytes()) for i, g in enumerate(self.gs) if cut[i + 1] > cut[i]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _ANSWERS)], schema=_ANSWERS)


def _gather(batches):
    """Blocks of rows that are sorted by bucket, one in memory at a time."""
    last, held = None, []
    for b in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in b.columns)):
            if held and bucket != last:
                yield _Block(last, held)
                held = []
            last = bucket
            held.append(row)
    if held:
        yield _Block(last, held)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Starts of the groups of sorted records."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _several(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of sorted keys: whether two documents hold the key."""
    start = _first_of(keys)
    if not len(start):
        return np.zeros(0, bool)
    lo, hi = np.minimum.reduceat(docs, start), np.maximum.reduceat(docs, start)
    return np.repeat(lo != hi, np.diff(np.append(start, len(keys))))


def _settle(batches):
    """Step 1: settled suffixes (kind 1) and open ones (kind 2); anchors of slices (kind 0) are passed on."""
    for x in _gather(batches):
        if x.bucket < 0:
            yield x.passed_on()
            continue
        by = np.lexsort((x.docs, x.second, x.keys))
        k, c, d = x.keys[by], x.second[by], x.docs[by]
        start = _first_of(k, c)
        settled = d > np.repeat(d[start], np.diff(np.append(start, len(d))))
        rest = np.flatnonzero(~settled)
        marks = np.zeros((2, len(d)), bool)
        marks[0][by[settled]] = True
        marks[1][by[rest[_several(k[rest], d[rest])]]] = True
        yield x.answer(marks[0], 1)
        yield x.answer(marks[1], 2)


def _share(batches):
    """Step 2: halves that two documents hold (kind 3)."""
    for x in _gather(batches):
        by = np.argsort(x.keys, kind="stable")
        marks = np.zeros(len(by), bool)
        marks[by[_several(x.keys[by], x.docs[by])]] = True
        yield x.answer(marks, 3)


def _compare(batches):
    """Step 3: strings that stand in a smaller document (kind 4)."""
    for x in _gather(batches):
        by = np.lexsort((x.docs, x.second, x.keys))
        d = x.docs[by]
        start = _first_of(x.keys[by], x.second[by])
        marks = np.zeros(len(d), bool)
        marks[by[d > np.repeat(d[start], np.diff(np.append(start, len(d))))]] = True
        yield x.answer(marks, 4)


def _marks(answers: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The records of this slice that were marked: answers count within a bucket, in the order in which records were packed."""
    own = [(b, np.frombuffer(a, np.uint32)) for a, k, b in zip(*(answers.column(c).to_pylist() for c in ("at", "kind", "bucket"))) if k == kind]
    if not own:
        return np.zeros(0, np.int64)
    places = _spread(keys, keys, buckets)
    return np.sort(np.concatenate([places[b][a] for b, a in own]))


def _sliced(docs: DataFrame) -> tuple[DataFrame, int, Callable[[], None]]:
    """The texts in slices of about SLICE bytes, bucketed by slice; their bytes; and what drops the table."""

    def cut(batches):
        g, room, r = 0, 0, 0
        for b in batches:
            _, off = B.utf8(b.column(1))
            size = np.diff(off)
            gs, rs = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for i, n in enumerate(size.tolist()):
                if room < n or r == 0:
                    g, room, r = uuid.uuid4().int >> 65, SLICE, 0
                gs[i], rs[i] = g, r
                room, r = room - n, r + 1
            yield pa.record_batch([pa.array(gs), pa.array(rs), b.column(0), b.column(1), pa.array(size)], names=["g", "r", "doc_id", "text", "n_bytes"])

    spark, n = docs.sparkSession, partitions(docs)
    rows = documents(docs).mapInArrow(cut, "g long, r long, doc_id long, text string, n_bytes long")
    name, path = f"lekhaspark_slices_{uuid.uuid4().hex}", fresh_path(spark, "slices")
    rows.write.bucketBy(n, "g").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)

    return table, table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0], drop


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, spans (start, end in bytes of the removed runs),
    kept_sha256 (of the bytes that stay). A byte goes when a string of `length` bytes covers
    it that also stands in a document with a smaller doc_id."""
    if length <= 2 * GRAM:
        raise ValueError(f"length must be over {2 * GRAM}")
    slices, total, drop_slices = _sliced(docs)
    n = partitions(docs)
    buckets = max(n, total // _BUCKET_BYTES + 1)

    def again(table: pa.Table, answers: pa.Table) -> _Slice:
        """A slice with the anchors that the first step has found."""
        gaps = [a for a, k in zip(answers.column("at").to_pylist(), answers.column("kind").to_pylist()) if k == 0]
        return _Slice(table, length, gaps[0])

    def sides(s: _Slice, answers: pa.Table):
        suffixes, _ = s.suffixes()
        open_ = suffixes.spread(_marks(answers, 2, s.keys[suffixes.one], buckets))
        index, side, h = s.halves(open_)
        return open_[index], side, _Distinct(s.docs[s.row[open_[index]]], h), h

    def ends(s: _Slice, answers: pa.Table) -> np.ndarray:
        anchor, side, halves, h = sides(s, answers)
        # two documents of this slice, or this one and another
        shared = (halves.least != halves.most)[halves.of]
        marked = np.zeros(len(halves.one), bool)
        marked[_marks(answers, 3, np.concatenate((h[halves.one], h[halves.one])), buckets) % max(1, len(marked))] = True
        shared |= marked[halves.of]
        return s.strings(anchor[shared], side[shared])

    def anchored(key, table):
        s = _Slice(table, length)
        suffixes, second = s.suffixes()
        one = suffixes.one
        return _packed(key[0].as_py(), s.keys[one], second[one], suffixes.least, buckets, s.gaps())

    def halved(key, table, answers):
        s = again(table, answers)
        _, _, halves, h = sides(s, answers)
        # the least and the greatest document that hold a half: enough for others to know whether it is shared
        twice = np.concatenate((h[halves.one], h[halves.one]))
        return _packed(key[0].as_py(), twice, None, np.concatenate((halves.least, halves.most)), buckets)

    def names(s: _Slice, starts: np.ndarray) -> tuple[_Distinct, np.ndarray, np.ndarray]:
        a, b = s.names(starts)
        return _Distinct(s.docs[np.searchsorted(s.off, starts, "right") - 1], a, b), a, b

    def around(key, table, answers):
        s = again(table, answers)
        strings, a, b = names(s, ends(s, answers))
        return _packed(key[0].as_py(), a[strings.one], b[strings.one], strings.least, buckets)

    def finish(key, table, answers):
        s = again(table, answers)
        change = np.zeros(len(s.data) + 1, np.int32)
        suffixes, _ = s.suffixes()
        settled = np.concatenate((np.flatnonzero(suffixes.later), suffixes.spread(_marks(answers, 1, s.keys[suffixes.one], buckets))))
        np.add.at(change, s.first[settled], 1)
        np.add.at(change, s.last[settled], -1)
        starts = ends(s, answers)
        strings, a, _ = names(s, starts)
        starts = starts[np.concatenate((np.flatnonzero(strings.later), strings.spread(_marks(answers, 4, a[strings.one], buckets))))]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        lo, hi = B.runs(gone, s.off)
        row = np.searchsorted(s.off, lo, "right") - 1
        cut = np.searchsorted(row, np.arange(len(s.ids) + 1))
        sha, removed, spans = [], [], []
        for i, (a, b) in enumerate(zip(s.off[:-1].tolist(), s.off[1:].tolist())):
            own = slice(cut[i], cut[i + 1])
            sha.append(hashlib.sha256((s.data[a:b][~gone[a:b]] if cut[i + 1] > cut[i] else s.data[a:b]).tobytes()).hexdigest())
            removed.append(int((hi[own] - lo[own]).sum()))
            spans.append([{"start": int(x) - a, "end": int(y) - a} for x, y in zip(lo[own], hi[own])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([s.ids, pa.array(np.diff(s.off)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    by_slice = slices.select("g", "r", "doc_id", "text").groupBy("g")
    records = by_slice.applyInArrow(anchored, _RECORDS_DDL)
    found = written(records.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle, _ANSWERS_DDL), "settled")
    records = by_slice.cogroup(found.where("kind in (0, 2)").groupBy("g")).applyInArrow(halved, _RECORDS_DDL)
    shared = written(records.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_share, _ANSWERS_DDL), "shared")
    records = by_slice.cogroup(found.where("kind in (0, 2)").union(shared).groupBy("g")).applyInArrow(around, _RECORDS_DDL)
    strings = written(records.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare, _ANSWERS_DDL), "strings")
    every = found.union(shared).union(strings)
    result = by_slice.cogroup(every.groupBy("g")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    )
    result = written(result, "removed")
    forget(found, shared, strings)
    drop_slices()
    return result

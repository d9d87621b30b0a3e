"""Operator 10: benchmark decontamination by a BM25 index with block-max WAND.

The index holds inverted lists of the test items. For a term and an item it has the BM25 impact,
divided by the sum of the item's impacts, so that a passage which contains all of
an item scores 1. Items stand in blocks; a term has the highest impact of all its list and of
each block. Every document is cut into overlapping passages, and every
passage is a query over the whole index. As in WAND, the terms of a passage are put in order of their
highest impacts; up to a pivot they cannot reach the threshold together, so only blocks on the lists
from the pivot on are looked at. Then the highest impacts of the block, summed over all terms of the
passage, bound what any item of it can score, and only the items of blocks whose bound reaches the threshold
are scored. All passages of a slice of texts go through these steps together. Nothing that reaches the threshold is lost, and
there is no limit on how many are retrieved. A retrieved item counts
when both parts of it, question and answer, are there, or WHOLE_OVERLAP of it in order
without regard to the parts (a passage cut off before the answer). A part is there by word
three-grams or by words in order, whichever share is higher: one changed word in a short
answer leaves no three-gram of it. Words in order are counted in the stretch of the passage,
little longer than the item, that holds most words of the item; words of the answer count
only after the question, and those of the question before the answer.

At most PART_WORDS words of items are broadcast at once; a larger benchmark is cut
into such parts, with idf over all items, and the documents are read once for each part.

Defined cases: items and documents without words match nothing; an empty benchmark or no documents give an
empty result; repeated items are items of their own; of equal scores every item is reported; repeated rows of a
doc_id give one row for each item; very long texts are read whole, in passages; null doc_ids are never reported;
`clean` tests every row on its own text, whatever its doc_id; only doc_id, text and item_id are
read, so further columns may bear any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import forget, written

K1, LENGTH_WEIGHT = 1.2, 0.75
THRESHOLD = 0.5
PART_OVERLAP = 0.5
WHOLE_OVERLAP = 0.6
GRAM = 3
BLOCK = 8
SEGMENT = 64
#: The most words of items in what is broadcast at once (one item at least): about 16 bytes of lists for each word.
PART_WORDS = 1 << 20
#: Entries of lists in one step, a bound on its memory.
CHUNK = 1 << 20
ROUNDING = 1e-9

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, A-Z folded) and the words of each row."""
    data = B.LOWER[data]
    s, e = B.runs(_IN_WORD[data], off)
    row = np.searchsorted(off, s, "right") - 1
    return B.mix(B.span_hash(B.prefix_hash(data), s, e) + (e - s).astype(B.U), 11), np.bincount(row, minlength=len(off) - 1)


def _text_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[0]


def _grams(h: np.ndarray) -> np.ndarray:
    k = min(GRAM, len(h))
    out = np.zeros(len(h) - k + 1 if k else 0, B.U)
    for j in range(k):
        out = B.mix(out ^ h[j : j + len(out)], j + 1)
    return out


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The answer is the last sentence, lengthened to a quarter of the item and four words; the question is what stands before it."""
    parts = [p for p in (_text_words(x) for x in re.split(r"(?<=[.!?])\s+|\n+", text)) if len(p)]
    whole = np.concatenate(parts) if parts else np.zeros(0, B.U)
    if len(whole) < 2 * GRAM:
        return whole, whole
    k = 0
    for p in reversed(parts):
        k += len(p)
        if k >= max(4, len(whole) / 4):
            break
    if k > len(whole) * 2 / 3:
        k = len(whole) // 3
    return whole[:-k], whole[-k:]


def _in_order(words: list[int], passage: list[int]) -> int:
    """Bits of `words`: unset ones among the first k count the longest common subsequence of words[:k] and the passage."""
    places: dict[int, int] = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(words)) - 1
    v = full
    for w in passage:
        m = places.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return v


def word_overlaps(item: np.ndarray, n_question: int, passage: np.ndarray) -> tuple[float, float, float]:
    """Shares of question, answer and item whose words stand in order where the passage is most like the item.

    n_question is 0 for an item that is its own question and answer."""
    size = len(item) + max(2, len(item) // 4)
    if len(passage) > size:
        held = np.concatenate(([0], np.cumsum(np.isin(passage, item))))
        first = int(np.argmax(held[size:] - held[:-size]))
        passage = passage[first : first + size]
    words, passage = item.tolist(), passage.tolist()
    v = _in_order(words, passage)
    whole = len(words) - v.bit_count()
    if not n_question:
        return (whole / len(words),) * 3
    n_answer = len(words) - n_question
    answer = n_answer - _in_order(words[n_question:], passage).bit_count()
    question = n_question - (v & (1 << n_question) - 1).bit_count()
    return (whole - answer) / n_question, (whole - question) / n_answer, whole / len(words)


class Index:
    """Inverted lists of items of one length class.

    For each term: its highest impact; the blocks of items it stands in, with the highest impact in
    each; and for each of these entries the items, with their impacts. Lists are sorted codes (term, block) and (term, item)."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean: float):
        self.ids = [i for i, _ in items]
        parts = [question_and_answer(t) for _, t in items]
        self.parts = [tuple(np.unique(_grams(x)) for x in p) for p in parts]
        self.words = words = [_text_words(t) for _, t in items]
        self.n_question = [len(q) if len(q) < len(w) else 0 for (q, _), w in zip(parts, words)]
        self.segment = max(SEGMENT, *map(len, words))
        self.terms = np.unique(np.concatenate(words))
        self.n_blocks = -(-len(items) // BLOCK)
        codes, impacts = [], []
        for j, w in enumerate(words):
            t, tf = np.unique(w, return_counts=True)
            seen = np.array([df[int(x)] for x in t.view(np.int64)])
            idf = np.log(1 + (n_items - seen + 0.5) / (seen + 0.5))
            v = idf * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * len(w) / mean))
            codes.append(np.searchsorted(self.terms, t).astype(np.int64) * len(items) + j)
            impacts.append(v / v.sum())
        code, impact = np.concatenate(codes), np.concatenate(impacts)
        by = np.argsort(code)
        self.item_code, self.impact = code[by], impact[by]
        term, item = np.divmod(self.item_code, len(items))
        block = term * self.n_blocks + item // BLOCK
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        self.block_code, self.block_max = block[first], np.maximum.reduceat(self.impact, first)
        self.entry_ptr = np.append(first, len(self.item_code))
        self.block_ptr = np.searchsorted(self.block_code // self.n_blocks, np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.block_max, self.block_ptr[:-1])

    def above(self, h: np.ndarray, count: np.ndarray):
        """(first word, row, item, score) of all passages and items whose score reaches the threshold. A passage is two
        segments of a row, or the last one; h are the words of the rows, count how many each has."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == h)
        if not len(known):
            return
        ends = np.cumsum(count)
        row = np.searchsorted(ends, known, "right")
        n_seg = -(-count // self.segment)
        seg_base = np.cumsum(n_seg) - n_seg
        seg = seg_base[row] + (known - (ends - count)[row]) // self.segment
        owner = np.repeat(np.arange(len(count)), n_seg)
        # each segment's terms belong to the passage that starts there and to the one that starts before it
        earlier = seg[(seg > 0)]
        back = owner[earlier - 1] == owner[earlier]
        code = np.concatenate((seg, earlier[back] - 1)) * len(self.terms) + np.concatenate((at[known], at[known][seg > 0][back]))
        passage, term = np.divmod(np.unique(code), len(self.terms))
        # what all terms of a passage can give at most
        top = self.term_max[term]
        likely = np.bincount(passage, top)[passage] >= THRESHOLD - ROUNDING
        passage, term, top = passage[likely], term[likely], top[likely]
        if not len(passage):
            return
        # the pivot: the terms before it, weakest first, cannot reach the threshold together, so an item needs one from it on
        by = np.lexsort((top, passage))
        passage, term, top = passage[by], term[by], top[by]
        starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        cut = np.append(starts, len(passage))
        total = np.cumsum(top)
        strong = total - np.repeat(total[starts] - top[starts], np.diff(cut)) >= THRESHOLD - ROUNDING
        width = self.block_ptr[term + 1] - self.block_ptr[term]
        for lo, hi in _ranges(np.add.reduceat(width, starts) + self.n_blocks):
            own = slice(cut[lo], cut[hi])
            n = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
            for which, item, score in self._scored(n, term[own], top[own], strong[own], hi - lo):
                s = int(passage[starts[lo + which]])
                r = int(owner[s])
                yield int(ends[r] - count[r] + (s - seg_base[r]) * self.segment), r, item, score

    def _scored(self, passage: np.ndarray, term: np.ndarray, top: np.ndarray, strong: np.ndarray, n: int):
        """(passage, item, score) that reach the threshold, of n passages with these terms; strong: from the pivot on."""

        def lists(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The entries of the lists of terms, and for each its passage and block as one number."""
            lo, hi = self.block_ptr[term[mask]], self.block_ptr[term[mask] + 1]
            entry = _spans(lo, hi)
            return entry, np.repeat(passage[mask], hi - lo) * self.n_blocks + self.block_code[entry] % self.n_blocks

        # blocks on the lists from the pivot on: what these give, and what the terms before it give at most
        entry, at = lists(strong)
        given = np.bincount(at, self.block_max[entry], n * self.n_blocks).reshape(n, self.n_blocks)
        before = np.bincount(passage, np.where(strong, 0.0, top), n)
        near = (given > 0) & (given + before[:, None] >= THRESHOLD - ROUNDING)
        # there the lists before the pivot count as well
        weak, at_weak = lists(~strong & near.any(axis=1)[passage])
        near = near.ravel()
        entry, at = (np.concatenate((x[near[at]], y[near[at_weak]])) for x, y in ((entry, weak), (at, at_weak)))
        open_ = np.bincount(at, self.block_max[entry], n * self.n_blocks) >= THRESHOLD - ROUNDING
        entry, at = entry[open_[at]], at[open_[at]]
        # the items of the open blocks
        lo, hi = self.entry_ptr[entry], self.entry_ptr[entry + 1]
        place = _spans(lo, hi)
        pair, of = np.unique(np.repeat(at // self.n_blocks, hi - lo) * len(self.ids) + self.item_code[place] % len(self.ids), return_inverse=True)
        score = np.bincount(of, self.impact[place], len(pair))
        for k in np.flatnonzero(score >= THRESHOLD - ROUNDING).tolist():
            yield int(pair[k]) // len(self.ids), int(pair[k]) % len(self.ids), float(score[k])

    def search(self, h: np.ndarray, count: np.ndarray):
        """(row, item_id, score, question, answer) of what `above` finds and the passage holds both parts or most of the item."""
        ends = np.cumsum(count)
        for lo, r, item, score in self.above(h, count):
            passage = h[lo : min(lo + 2 * self.segment, ends[r])]
            got, whole = _grams(passage), 0.0
            q, a = (float(np.isin(p, got).mean()) if len(p) else 0.0 for p in self.parts[item])
            if q < PART_OVERLAP or a < PART_OVERLAP:
                by_word = word_overlaps(self.words[item], self.n_question[item], passage)
                q, a, whole = max(q, by_word[0]), max(a, by_word[1]), by_word[2]
            if q >= PART_OVERLAP and a >= PART_OVERLAP or whole >= WHOLE_OVERLAP:
                yield r, self.ids[item], score, q, a


def _ranges(size: np.ndarray):
    """Ranges (first, last) of rows of about CHUNK in all, one row at least."""
    done, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + CHUNK, "right")))
        yield lo, hi
        lo = hi


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo..hi, one after another."""
    size = (hi - lo).astype(np.int64)
    first = np.cumsum(size) - size
    return np.repeat(lo - first, size) + np.arange(int(size.sum()))


def _indexes(benchmark: DataFrame):
    """Parts of the benchmark of about PART_WORDS words, each a list of indexes of items of like length."""

    def terms(batches):
        for b in batches:
            data, off = B.utf8(b.column(1))
            h, n = _words(data, off)
            row = np.repeat(np.arange(b.num_rows), n)
            ids = b.column(0).take(pa.array(row))
            yield pa.record_batch([ids, pa.array(h.view(np.int64)), pa.array(n[row].astype(np.int64))], names=["item_id", "term", "n"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = written(items.mapInArrow(terms, "item_id long, term long, n long").distinct(), "item_words")
    n_items, total = words.groupBy("item_id").agg(F.max("n").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_parts = max(1, -(-total // PART_WORDS))
    df = written(words.groupBy("term").agg(F.countDistinct("item_id").alias("df")), "item_df")
    for k in range(n_parts):
        own = F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == k
        part = [(r["item_id"], r["text"]) for r in items.where(own).collect()]
        seen = {r["term"]: r["df"] for r in df.join(words.where(own).select("term").distinct(), "term").collect()}
        groups: list[list] = []
        for n, i, t in sorted((len(_text_words(t)), i, t) for i, t in part):
            if not n:
                continue
            if not groups or n > max(SEGMENT, 2 * groups[-1][0][0]):
                groups.append([])
            groups[-1].append((n, i, t))
        yield [Index([(i, t) for _, i, t in g], seen, n_items, total / max(1, n_items)) for g in groups]
    forget(words, df)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each item that a document contains."""
    spark = docs.sparkSession
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    out = None
    for indexes in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(indexes)

        def search(batches, shared=shared):
            for b in batches:
                data, off = B.utf8(b.column(1))
                ids, best = b.column(0).to_pylist(), {}
                for lo, hi in B.slices(off):
                    h, n = _words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    for index in shared.value:
                        for r, item, score, q, a in index.search(h, n):
                            key = ids[lo + r], item
                            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
                rows = [(*k, *v) for k, v in best.items()]
                cols = [*zip(*rows)] if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = base.mapInArrow(search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m"))
    return best.select("doc_id", "item_id", *[F.round(f"m.{c}", 4).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text contains an item. A row is known by a hash of its doc_id and text, so that rows
    without a doc_id, and rows of different text that share one, are judged each for itself."""
    key = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    gone = find(docs.select(key.alias("doc_id"), docs["text"].alias("text")), benchmark).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, key == gone["_gone"], "left_anti").select(docs.columns)

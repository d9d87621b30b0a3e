"""Operator 4: exact token counts at every prefix by dynamic programming.

The pre-tokenizer of the vocabulary file cuts a text into pieces (words, single
digits, runs of signs); byte-pair encoding never crosses a piece. For a piece,
the last token of the encoding of every prefix follows from shorter prefixes:
it is the one token t that ends there and may follow the last token of the
prefix before t, where "may follow" means that the two tokens encode to
themselves. So count[i] = count[i - len(t)] + 1, for every i, with and without
the mark that ends a word. Counts of a text are running sums over its pieces.

The program runs over all distinct pieces of a batch at once, one numpy step
for each end and token length; no text is encoded again to answer for one of
its prefixes. Only pairs of tokens are ever tested with the merge rules.

`token_prefixes` stores for each document the count at every code point, that of the
text cut there; `tokens_before` answers for any cut, and `fit` for any budget. Where a cut
changes what stands before it (within a letter and its accents, an ending such as 're, a
special string), the last pieces of the cut text are made again by the library's rules.

Defined cases: a null or empty text has 0 tokens; a very long text is one slice
of its own; repeated rows count alike; a null doc_id is kept; an empty table gives an empty
result; only doc_id and text are read, so further columns may bear any name.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import documents

_MODELS: dict[str, "PairModel"] = {}
#: Bounds: bytes of distinct pieces whose prefix counts are kept, and segments of text that are kept with their pieces.
KEPT_BYTES, KEPT_SEGMENTS, SHORT = 1 << 23, 1 << 16, 64
#: Endings of which the first letter alone is no ending.
_LONG_ENDINGS = ("'re", "'ve", "'ll")


def _byte_letters() -> dict[str, int]:
    """The usual spelling of bytes as printable characters in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairModel:
    """A byte-pair vocabulary whose last letter of a word bears an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        self.mark = model["end_of_word_suffix"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()}
        plain, ending = [], []
        for token, i in model["vocab"].items():
            stem, into = (token[: -len(self.mark)], ending) if token.endswith(self.mark) else (token, plain)
            into.append((bytes(letters[c] for c in stem), i))
        self.table = {"plain": _Lookup(plain), "ending": _Lookup(ending)}
        self.longest = max(self.table["plain"].longest, self.table["ending"].longest)
        self.made: dict[str, tuple[tuple[str, str], int]] = {}
        for pair, rank in self.rank.items():
            self.made.setdefault(pair[0] + pair[1], (pair, rank))
        self.edges: dict[int, list[tuple[str, int]]] = {}
        self.pairs, self.words = B.LongMap(21), B.LongMap(22)
        #: Prefix counts of the pieces that `words` knows; the map has their places.
        self.kept, self.used = np.zeros(KEPT_BYTES, np.int32), 0

    def may_follow(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether `after` may stand after `before`; -1 before stands for the start of a piece."""
        code = ((before.astype(np.int64) + 1) << 32 | after).view(B.U)
        got = self.pairs.get(code)
        if (got < 0).any():
            new = B.distinct(code[got < 0])
            good = np.array([self._pair((c >> 32) - 1, c & 0xFFFFFFFF) for c in new.tolist()], np.int64)
            self.pairs.put(new, good)
            miss = got < 0
            got[miss] = good[np.searchsorted(new, code[miss])]
        return got > 0

    def _edge(self, token: int, side: int) -> list[tuple[str, int]]:
        """What stands at the left (0) or right (1) end of a token as it is built from its letters: each part and
        the rank of the merge that takes it up."""
        key = 2 * token + side
        if key not in self.edges:
            name, death, out = self.names[token], sys.maxsize, []
            while name in self.made:
                out.append((name, death))
                parts, death = self.made[name]
                name = parts[side]
            self.edges[key] = [(name, death), *reversed(out)]
        return self.edges[key]

    def _pair(self, before: int, after: int) -> bool:
        """No merge across the border comes due while its two parts stand there. Of equal ranks the left goes first."""
        if before < 0:
            return True
        left, right, i, j = self._edge(before, 1), self._edge(after, 0), 0, 0
        while True:
            (a, a_death), (b, b_death) = left[i], right[j]
            due = self.rank.get((a, b), sys.maxsize)
            if due < a_death and due <= b_death and due < sys.maxsize:
                return False
            if a_death == b_death == sys.maxsize:
                return True
            if a_death <= b_death:
                i += 1
            else:
                j += 1


class _Lookup:
    """Token of a byte string, by hash: a small filter first, then a sorted table."""

    def __init__(self, tokens: list[tuple[bytes, int]]):
        data = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        size = np.array([len(t) for t, _ in tokens])
        ends = np.cumsum(size)
        self.longest = int(size.max())
        h = B.mix(B.span_hash(B.prefix_hash(data), ends - size, ends), 7)
        by = np.argsort(h)
        self.hashes, self.ids = h[by], np.array([i for _, i in tokens], np.int64)[by]
        assert len(np.unique(h)) == len(h)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[h >> B.U(42)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        h = B.mix(hashes, 7)
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.filter[h >> B.U(42)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        good = self.hashes[at] == h[maybe]
        out[maybe[good]] = self.ids[at[good]]
        return out


def model(path: str) -> PairModel:
    if path not in _MODELS:
        _MODELS[path] = PairModel(path)
    return _MODELS[path]


def prefix_counts(m: PairModel, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Token counts of all prefixes of the pieces data[start:end], flat: piece after piece, one count for each byte.

    The count at a byte is that of the piece cut after this byte, as a whole word."""
    size = end - start
    first = np.cumsum(size) - size
    last = np.full(int(size.sum()), -1, np.int64)
    inner = np.zeros(len(last), np.int64)
    whole = np.zeros(len(last), np.int64)
    prefix = B.prefix_hash(data)
    by = np.argsort(-size, kind="stable")
    sorted_size = -size[by]
    for i in range(1, int(size.max(initial=0)) + 1):
        long = by[: np.searchsorted(sorted_size, -i, "right")]
        cut = start[long] + i
        at = first[long] + i - 1
        for kind, counts in (("plain", inner), ("ending", whole)):
            todo, kinds = np.arange(len(long)), m.table[kind]
            for k in range(min(i, kinds.longest), 0, -1):
                if not len(todo):
                    break
                token = kinds(B.span_hash(prefix, cut[todo] - k, cut[todo]))
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                rows = todo[hit]
                before = last[at[rows] - k] if k < i else np.full(len(rows), -1, np.int64)
                open_ = before >= 0 if k < i else np.ones(len(rows), bool)
                good = np.zeros(len(rows), bool)
                if open_.any():
                    good[open_] = m.may_follow(before[open_], token[hit][open_])
                done = rows[good]
                counts[at[done]] = (inner[at[done] - k] if k < i else 0) + 1
                if kind == "plain":
                    last[at[done]] = token[hit][good]
                left = np.ones(len(todo), bool)
                left[hit[good]] = False
                todo = todo[left]
            if kind == "ending" and len(todo):
                raise ValueError("the vocabulary does not cover every byte")
    return whole


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """0 space, 1 letter, 2 number, 3 other, 4 what only the library's own rules should cut."""
    if not _CLASSES:
        table = np.full(0x110000, 4, np.uint8)
        for c in range(0x590):
            ch, kind = chr(c), unicodedata.category(chr(c))
            plain = len(ch.lower()) == 1 and unicodedata.normalize("NFC", ch) == ch and not unicodedata.combining(ch) and ch != "Σ" and kind != "Cn"
            if plain:
                table[c] = 0 if ch in "\t\n\x0b\x0c\r \x85\xa0" else 1 if kind[0] == "L" else 2 if kind[0] == "N" else 3
        _CLASSES.append(table)
    return _CLASSES[0]


class _Cut:
    """Pieces of a text, and for each code point the piece that a cut after it ends in (or stands before) and the bytes of it before the cut.

    `remade` has the code points whose cut changes the last pieces: (code point, whole pieces before, other pieces)."""

    __slots__ = ("data", "start", "end", "fixed", "piece", "bytes", "remade")

    def __init__(self, data: bytes, start, end, piece, bytes_, remade: list[tuple[int, int, list[bytes]]], fixed=None):
        self.data, self.remade = data, remade
        self.start, self.end, self.piece, self.bytes = (np.asarray(x, np.int64) for x in (start, end, piece, bytes_))
        self.fixed = np.zeros(len(self.start), np.int64) if fixed is None else np.asarray(fixed, np.int64)


def _cut_plain(text: str) -> _Cut:
    text = text.lower()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cls = _classes()[cp]
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    byte = np.concatenate(([0], np.cumsum(width)))
    new = np.ones(len(cls), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == 2)
    endings = []
    # a lone apostrophe takes an ending with it: 's 't 'm 'd 're 've 'll
    for p in np.flatnonzero((cp == 39) & new).tolist():
        tail = text[p + 1 : p + 3]
        take = 3 if tail in ("re", "ve", "ll") else 2 if tail[:1] in ("s", "t", "m", "d") and tail else 0
        if take:
            new[p + 1] = False
            if take == 3:
                new[p + 2] = False
                endings.append(p)
            if p + take < len(cls):
                new[p + take] = True
    first = new & (cls != 0)
    at = np.flatnonzero(first)
    stop = np.flatnonzero(np.concatenate((new[1:] | (cls[1:] != cls[:-1]) & ((cls[1:] == 0)), [True])) & (cls != 0)) + 1 if len(cls) else at
    begun, solid = np.cumsum(first), cls != 0
    inside = np.zeros(len(cls), np.int64)
    inside[solid] = byte[1:][solid] - byte[at[begun[solid] - 1]]
    remade = [(p + 1, int(begun[p]) - 1, [b"'", text[p + 1].encode()]) for p in endings]
    return _Cut(text.encode(), byte[at], byte[stop], begun - solid, inside, remade)


_LIBRARY: dict[str, object] = {}


def _library(path: str):
    if path not in _LIBRARY:
        from tokenizers import Tokenizer

        _LIBRARY[path] = Tokenizer.from_file(path)
    return _LIBRARY[path]


_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENTS: dict[tuple[str, str], _Cut] = {}
_JOINS: set[str] = set()


def _joins(ch: str) -> bool:
    """Whether normalising may change what stands before `ch`."""
    if not _JOINS:
        for c in range(0x110000):
            parts = unicodedata.decomposition(chr(c))
            if parts and parts[0] != "<":
                _JOINS.update(chr(int(x, 16)) for x in parts.split()[1:])
        _JOINS.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return ch in _JOINS or unicodedata.combining(ch) > 0


def _segment(text: str, path: str) -> _Cut:
    """A text without spaces and special strings, by the library's own normaliser and pre-tokenizer."""
    key = path, text
    if key in _SEGMENTS:
        return _SEGMENTS[key]
    if _classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].max() < 4:
        out = _cut_plain(text)
    else:
        lib, letters = _library(path), _byte_letters()

        def pieces(flat: str) -> list[tuple[bytes, int, int]]:
            return [(bytes(letters[c] for c in p), lo, hi) for p, (lo, hi) in lib.pre_tokenizer.pre_tokenize_str(flat)]

        starts = [i for i, ch in enumerate(text) if i == 0 or not _joins(ch)]
        norms = [lib.normalizer.normalize_str(text[s:e]) for s, e in zip(starts, [*starts[1:], len(text)])]
        flat = "".join(norms)
        if flat != lib.normalizer.normalize_str(text):
            starts, norms, flat = [0], [lib.normalizer.normalize_str(text)], lib.normalizer.normalize_str(text)
        own = pieces(flat)
        size = np.array([len(p) for p, _, _ in own], np.int64)
        ends = np.cumsum(size)
        width = np.cumsum([0, *(len(c.encode()) for c in flat)])
        in_piece, inside, remade = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), []
        j, at = 0, 0
        for s, e, norm in zip(starts, [*starts[1:], len(text)], norms):
            for c in range(s + 1, e):
                lo = own[j][1] if at else 0
                remade.append((c - 1, j, [p for p, _, _ in pieces(flat[lo:at] + lib.normalizer.normalize_str(text[s:c]))]))
            at += len(norm)
            while own[j][2] < at:
                j += 1
            _, lo, hi = own[j]
            in_piece[e - 1], inside[e - 1] = j, width[at] - width[lo]
            if at - lo == 2 and flat[lo:hi] in _LONG_ENDINGS:
                remade.append((e - 1, j, [b"'", flat[lo + 1].encode()]))
        out = _Cut(b"".join(p for p, _, _ in own), ends - size, ends, in_piece, inside, remade)
    if len(text) <= SHORT:
        if len(_SEGMENTS) >= KEPT_SEGMENTS:
            _SEGMENTS.clear()
        _SEGMENTS[key] = out
    return out


def _cut_slow(text: str, path: str) -> _Cut:
    """Segments between spaces and special strings; spaces and special strings are never part of a piece beside them."""
    import regex

    special = model(path).special
    split = regex.compile("(" + "|".join(map(regex.escape, special)) + f")|[^{_SPACES}]+?(?=[{_SPACES}]|$|" + "|".join(map(regex.escape, special)) + ")")
    data, start, end, fixed, remade = [], [], [], [], []
    in_piece, inside = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    n, base, at, before = 0, 0, 0, (-1, 0, "")
    for m in split.finditer(text):
        lo, hi = m.span()
        in_piece[at:lo] = n
        if m[1]:
            # a cut within the special string leaves plain text, which may go on from the segment before it
            _, n_first, left = before if before[2] and before[0] + len(before[2]) == lo else (lo, n, "")
            for c in range(lo + 1, hi):
                cut = _segment(left + text[lo:c], path)
                remade.append((c - 1, n_first, [cut.data[s:e] for s, e in zip(cut.start.tolist(), cut.end.tolist())]))
            start.append(np.array([base]))
            end.append(np.array([base]))
            fixed.append(np.array([1]))
            in_piece[hi - 1] = n + 1
            n, before = n + 1, (-1, 0, "")
        else:
            cut = _segment(m[0], path)
            before = (lo, n, m[0])
            data.append(cut.data)
            start.append(cut.start + base)
            end.append(cut.end + base)
            fixed.append(cut.fixed)
            in_piece[lo:hi], inside[lo:hi] = cut.piece + n, cut.bytes
            remade += [(c + lo, k + n, p) for c, k, p in cut.remade]
            n, base = n + len(cut.start), base + len(cut.data)
        at = hi
    in_piece[at:] = n
    none = [np.zeros(0, np.int64)]
    return _Cut(b"".join(data), np.concatenate(start or none), np.concatenate(end or none), in_piece, inside, remade, np.concatenate(fixed or none))


def _places(m: PairModel, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, place of each piece in it): the prefix counts of a piece follow its place, one for each byte."""
    h = B.mix(B.span_hash(B.prefix_hash(data), s, e) + (e - s).astype(B.U))
    place = m.words.get(h)
    place[e == s] = 0
    for again in (False, True):
        miss = np.flatnonzero(place < 0)
        if not len(miss):
            return m.kept, place
        by = miss[np.argsort(h[miss], kind="stable")]
        one = np.concatenate(([True], h[by][1:] != h[by][:-1]))
        ds, de = s[by[one]], e[by[one]]
        ends = np.cumsum(de - ds)
        full = m.used + ends[-1] > KEPT_BYTES or m.words.n + len(ds) > 1 << (m.words.bits - 1)
        if not full or again:
            break
        m.words.clear()
        m.used, place[e > s] = 0, -1
    found = np.empty(int(ends[-1]), np.int32)
    lo = 0
    while lo < len(ds):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + (1 << 22), "right")))
        found[done : ends[hi - 1]] = prefix_counts(m, data, ds[lo:hi], de[lo:hi])
        lo = hi
    new = ends - (de - ds)
    if full:  # more than is ever kept: a table of this batch alone
        place[by] = new[np.cumsum(one) - 1]
        return found, place
    m.kept[m.used : m.used + len(found)] = found
    m.words.put(h[by[one]], new + m.used)
    place[by] = (new + m.used)[np.cumsum(one) - 1]
    m.used += len(found)
    return m.kept, place


def batch_prefixes(texts: list[str], path: str) -> list[np.ndarray]:
    """For each text: the token count of the text cut after each of its code points."""
    m = model(path)
    table = _classes()
    cuts = []
    for t in texts:
        cp = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        cuts.append(_cut_slow(t, path) if len(cp) and (table[cp].max() == 4 or any(x in t for x in m.special)) else _cut_plain(t))
    if not cuts:
        return []
    bases = np.cumsum([0, *(len(c.data) for c in cuts)])
    others = [p for c in cuts for _, _, ps in c.remade for p in ps]
    other_end = np.cumsum([0, *map(len, others)]) + bases[-1]
    data = np.frombuffer(b"".join([*(c.data for c in cuts), *others]), np.uint8)
    s = np.concatenate([*(c.start + b for c, b in zip(cuts, bases)), other_end[:-1]]).astype(np.int64)
    e = np.concatenate([*(c.end + b for c, b in zip(cuts, bases)), other_end[1:]]).astype(np.int64)
    kept, place = _places(m, data, s, e)
    size = e - s
    counts = np.where(size > 0, kept[np.maximum(place + size - 1, 0)], 0).astype(np.int64)
    result, at, other = [], 0, len(s) - len(others)
    for c in cuts:
        n = len(c.start)
        before = np.concatenate(([0], np.cumsum(counts[at : at + n] + c.fixed)))
        here = np.append(place[at : at + n], 0)[c.piece]
        out = before[c.piece] + np.where(c.bytes > 0, kept[np.maximum(here + c.bytes - 1, 0)], 0)
        for k, whole, ps in c.remade:
            out[k] = before[whole] + counts[other : other + len(ps)].sum()
            other += len(ps)
        result.append(out.astype(np.int32))
        at += n
    return result


def token_prefixes(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, counts (tokens of the text cut after each of its code points)."""

    def run(batches):
        for b in batches:
            _, off = B.utf8(b.column(1))
            for lo, hi in B.slices(off):
                part = b.slice(lo, hi - lo)
                got = batch_prefixes(part.column(1).to_pylist(), path)
                at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32))
                n = [int(c[-1]) if len(c) else 0 for c in got]
                yield pa.record_batch(
                    [part.column(0), pa.array(np.diff(off[lo : hi + 1])), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(got)))],
                    names=["doc_id", "n_bytes", "n_tokens", "counts"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, counts array<int>")


def tokens_before(prefixes: DataFrame, cut) -> DataFrame:
    """Adds n_before: the tokens of the text cut after `cut` code points."""
    at = F.least(F.lit(cut) if isinstance(cut, int) else cut, F.size("counts"))
    return prefixes.withColumn("n_before", F.when(at > 0, F.element_at("counts", at)).otherwise(0).cast("long"))


def fit(prefixes: DataFrame, budget: int) -> DataFrame:
    """Adds fit_end: the longest cut, in code points, of at most `budget` tokens. A longer cut may have fewer tokens."""
    longest = F.array_max(F.transform("counts", lambda c, i: F.when(c <= F.lit(budget), i + 1).otherwise(0)))
    return prefixes.withColumn("fit_end", F.coalesce(longest, F.lit(0)).cast("long"))

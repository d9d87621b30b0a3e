"""Operator 9: toxicity by a weighted lexicon and Aho-Corasick.

Texts are folded first: compatibility forms, accents and look-alike letters of
other scripts become Latin letters, digits and signs that stand for letters
become these (1, |, ! and l are one letter), other signs become spaces, letters
drawn out three times or more become one, and words spelt letter by letter are
joined. One automaton then finds every lexicon entry - a word, or the beginning
of words - in one pass over the folded text.

The lexicon is learned: a word or beginning enters with its log-odds when
labelled documents show that it belongs to the toxic ones. A phrase of two words
around an entry that labelled documents show to be harmless becomes an exception, and
matches inside it do not count. A document's evidence is the sum of the weights
of its matched words, normalised by its length; a logistic curve, fitted on the same
documents, makes it a probability.

Learning reads at most `most_rows` labelled documents, chosen by hash; scoring
reads every text whole. labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has no evidence and gets the curve's base
probability; without labels of both kinds the lexicon is empty and every
score is 0.5 by the curve's prior or the share of the labels; repeated rows score alike, entries of equal weight stand in
the order of their letters; an empty table gives an empty result; very long texts are read whole; only doc_id, text and the labels'
toxic are read, so further columns may bear any name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that learning reads, at most (about): a bounded sample by hash.
MOST_ROWS = 20_000
STEMS = (4, 5, 6)
LEAST_SEEN = 5
LEAST_LOG_ODDS = 2.0
LEAST_Z = 4.0
LENGTH_UNIT = 200

# Letters of other scripts that look like Latin ones, and characters written for letters.
LOOK_ALIKES = dict(zip("авекмнорстухіјѕԁɡһӏɑαβεικνορτυχωβ", "abekmhopctyxijsdghiaabeiknoptuxwb"))
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "€": "e", "£": "i", "ß": "ss"}


class _Fold(dict):
    def __missing__(self, code: int):
        ch = unicodedata.normalize("NFKD", chr(code).lower())
        ch = "".join(LOOK_ALIKES.get(c, c) for c in ch if not unicodedata.combining(c))
        ch = "".join(STAND_INS.get(c, c) for c in ch)
        if unicodedata.category(chr(code)) == "Cf" or not ch:
            out = None
        else:
            out = "".join(c if c.isalnum() else " " for c in ch)
        self[code] = out
        return out


_FOLD = _Fold()
_LONG = re.compile(r"(\w)\1{2,}")
_SPELT = re.compile(r"(?<!\S)(?:\w ){2,}\w(?!\S)")


def fold(text: str) -> str:
    """Folded words, one space before, between and after them."""
    # a sign at the end of a word is punctuation, inside or before it a letter
    text = re.sub(r"[!|$@]+(?=\s|$)", " ", text)
    out = " ".join(text.translate(_FOLD).split())
    out = _LONG.sub(r"\1", out)
    out = _SPELT.sub(lambda m: m[0].replace(" ", ""), out)
    return f" {out} " if out else ""


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: list[str] = field(default_factory=list)  # " word word "
    slope: float = 1.0
    base: float = -3.0
    automaton: object = None

    def compile(self) -> "Model":
        import ahocorasick

        if self.automaton is None and self.lexicon:
            self.automaton = ahocorasick.Automaton()
            for k, w in self.lexicon.items():
                self.automaton.add_word(k, (len(k), w))
            for k in self.exceptions:
                self.automaton.add_word(k, (len(k), None))
            self.automaton.make_automaton()
        return self

    def evidence(self, folded: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of weights normalised by length, and the spans that count."""
        if self.automaton is None or not folded:
            return 0.0, []
        best: dict[int, tuple[int, float]] = {}
        calm: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(folded):
            start = end - size + 1
            if w is None:
                calm.append((start, end + 1))
            elif start not in best or w > best[start][1]:
                best[start] = end + 1, w
        spans, reach, at = [], 0, 0
        calm.sort()
        for s, (e, w) in sorted(best.items()):
            # reach: how far the exceptions go that begin at s or before
            while at < len(calm) and calm[at][0] <= s:
                reach = max(reach, calm[at][1])
                at += 1
            if e > reach:
                spans.append((s, e, w))
        n_words = folded.count(" ") - 1
        return sum(w for _, _, w in spans) / (1 + math.log1p(n_words / LENGTH_UNIT)), spans

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"} | {"automaton": None}


def _features(words: list[str]) -> set[str]:
    out = {f" {w} " for w in words if len(w) > 2}
    for n in STEMS:
        out.update(" " + w[:n] for w in words if len(w) > n)
    return out


def _counts(rows: DataFrame, features) -> DataFrame:
    """(f, n0, n1): labelled documents with each feature, counted in the task first."""

    def run(batches):
        for b in batches:
            seen = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(features(fold(t)))
            keys = list(seen[0] | seen[1])
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array([seen[0][k] for k in keys], pa.int64()), pa.array([seen[1][k] for k in keys], pa.int64())], names=["f", "n0", "n1"])

    got = rows.select("text", "toxic").mapInArrow(run, "f string, n0 long, n1 long")
    return got.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(text, toxic) of a bounded sample by hash of the labelled documents. Ids with labels of both kinds are left out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("a"), F.max("toxic").alias("b")).where("a = b")
    n = known.count()
    share = min(1.0, most_rows / max(1, n))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1)).select("doc_id", F.col("a").cast("int").alias("toxic"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    return texts.join(picked, "doc_id").select("text", "toxic")


def learn(rows: DataFrame) -> Model:
    """The model of rows (text, toxic), a bounded table."""
    from .store import written

    rows = written(rows, "labelled")
    n1, n0 = (rows.where(F.col("toxic") == k).count() for k in (1, 0))
    model = Model()
    if not n0 or not n1:
        model.base, model.slope = (0.0 if n0 == n1 else math.log((n1 + 1) / (n0 + 1))), 0.0
        return model
    log_odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    rate = F.lit(n1 / (n0 + n1))
    z = (F.col("n1") - (F.col("n0") + F.col("n1")) * rate) / F.sqrt((F.col("n0") + F.col("n1")) * rate * (1 - rate))
    strong = _counts(rows, lambda t: _features(t.split())).where(F.col("n1") >= LEAST_SEEN).withColumn("w", log_odds).withColumn("z", z)
    # all that pass the tests: the bounded sample of rows bounds them
    strong = strong.where((F.col("w") >= LEAST_LOG_ODDS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "f")
    model.lexicon = {r["f"]: float(r["w"]) for r in strong.select("f", "w").collect()}
    model.compile()

    def around(folded: str) -> set[str]:
        out = set()
        for s, e, _ in model.compile().evidence(folded)[1]:
            word_end = folded.find(" ", s + 1)
            before = folded.rfind(" ", 0, s) if s else -1
            after = folded.find(" ", word_end + 1)
            if before >= 0:
                out.add(folded[before : word_end + 1])
            if after >= 0:
                out.add(folded[s : after + 1])
        return out

    calm = _counts(rows, around).where((F.col("n0") >= LEAST_SEEN) & ((F.col("n1") + 0.5) / (F.col("n0") + 1) <= rate / (1 - rate)))
    model.exceptions = [r["f"] for r in calm.orderBy(F.desc("n0"), "f").collect()]
    model.automaton = None
    model.compile()

    def bins(batches):
        for b in batches:
            x = [round(model.compile().evidence(fold(t))[0], 1) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.float64()), b.column(1)], names=["x", "toxic"])

    got = rows.mapInArrow(bins, "x double, toxic int").groupBy("x").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).collect()
    x, k, n = (np.array([float(r[c]) for r in got]) for c in ("x", "k", "n"))
    model.base, model.slope = _logistic(x, k, n)
    return model


def _logistic(x: np.ndarray, k: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope (not negative) of k of n at x, by Newton's method with a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = n * p * (1 - p)
        g = np.array([(k - n * p).sum() - ridge * a, ((k - n * p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    return float(a), max(0.0, float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, evidence, score, predicted, matches (folded entries that counted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its entries stand in at least LEAST_SEEN of at most MOST_ROWS labelled rows

    def run(batches):
        m = shared.value.compile()
        for b in batches:
            x, found = [], []
            for t in b.column(1).to_pylist():
                folded = fold(t or "")
                v, spans = m.evidence(folded)
                x.append(v)
                found.append([folded[s:e].strip() for s, e, _ in spans])
            p = 1 / (1 + np.exp(-(m.base + m.slope * np.array(x, float))))
            yield pa.record_batch([b.column(0), pa.array(x, pa.float64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "evidence", "score", "predicted", "matches"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, evidence double, score double, predicted int, matches array<string>")


def held_out(doc_id):
    """Whether a doc_id is in the fold that learning never sees; without a doc_id (the crc32 of nothing) it is."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0

"""Operator 6: near-duplicate lines by a deletion-neighbourhood join.

Two lines are the same when at most one word differs, is missing or is added
(edit distance 1 over words); with fewer than `least_words` words in both lines only when they
are equal. Of the same lines the earliest (by doc_id, then place) stays; a line
goes when an earlier one is the same as it.

* Equal lines are one entry, found by a 128-bit hash; only hashes travel, and
  whatever follows works on entries, so a line that stands everywhere counts once.
* An entry can have a partner only if some other entry shares its first or last half:
  a grouped minimum and maximum over half-line hashes, combined before the
  shuffle, drops all others.
* The rest emit their deletion neighbourhood as hashed keys: the line itself, and the
  line without word i, keyed with i (for a replaced word) and without it (for an
  added one). Equal keys meet in a grouped minimum - no pairs are made, so a
  key that a third of all lines share costs one row for each line.
* The entry and the earliest holder of its key are compared word by word.

Defined cases: a null text has no lines; a line without words is never a
duplicate and is kept; rows with one doc_id are taken in the order of their text hash,
and rows with equal doc_id and text are reported once; a
null doc_id comes first; an empty table gives an empty result; very long texts and lines are
read whole; only doc_id and text are read, so further columns may bear any name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import documents, forget, written

LEAST_WORDS = 8
_POSITION = "struct<doc_id: long, text_hash: long, line: int>"


def _short(kind: int, parts: list[bytes]) -> int:
    """64 bits: what meets by it is compared word by word later."""
    x = xxhash.xxh3_64_intdigest(b" ".join(parts), kind)
    return x - (1 << 64) if x >> 63 else x


def _placed(key: int, at: int) -> int:
    """The same key for one place of the missing word only."""
    x = (key + (at + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
    return x - (1 << 64) if x >> 63 else x


def _key(kind: int, *parts: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(parts), digest_size=16, salt=kind.to_bytes(8, "little")).digest()


def _line_rows(docs: DataFrame, least_words: int) -> DataFrame:
    """One row for each line with a word: doc_id, text_hash, line, id (hash of its words), n_words, n_chars, halves."""

    def run(batches):
        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
            _, off = B.utf8(b.column(1))
            for lo, hi in B.slices(off):
                cols: list[list] = [[] for _ in range(7)]
                for i, text in zip(range(lo, hi), b.column(1).slice(lo, hi - lo).to_pylist()):
                    for at, line in enumerate(text.split("\n")):
                        words = line.encode().split()
                        n = len(words)
                        if n:
                            halves = {_short(k, words[:q] if k % 2 == 0 else words[n - q :]) for m in (n, n - 1) for q in (m // 2,) for k in (2 * q, 2 * q + 1)}
                            for c, v in zip(cols, (ids[i], hashes[i], at, _key(0, *words), n, len(line), sorted(halves) if n >= least_words - 1 else [])):
                                c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "text_hash", "line", "id", "n_words", "n_chars", "halves"])

    rows = documents(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, line int, id binary, n_words int, n_chars long, halves array<long>")


def _texts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(pos, words) of the lines in `firsts` (pos, id)."""
    wanted = firsts.groupBy(F.col("pos.doc_id").alias("doc_id"), F.col("pos.text_hash").alias("text_hash")).agg(F.collect_set("pos.line").alias("at"))
    texts = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    met = texts.join(wanted.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    picked = met.select("doc_id", "text_hash", F.explode("at").alias("line"), F.split("text", "\n").alias("lines"))
    return picked.select(F.struct("doc_id", "text_hash", "line").alias("pos"), F.expr("lines[line]").alias("words")).distinct()


def same_but_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance over words is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    n, i = min(len(a), len(b)), 0
    while i < n and a[i] == b[i]:
        i += 1
    rest = (a[i + 1 :], b[i + 1 :]) if len(a) == len(b) else (a[i + 1 :], b[i:]) if len(a) > len(b) else (a[i:], b[i + 1 :])
    return a == b or rest[0] == rest[1]


def _with_partner(keyed: DataFrame) -> DataFrame:
    """The rows (short, t, ...) whose key t another entry has as well; the join splits keys that very many have."""
    shared = keyed.groupBy("t").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo < hi").select("t")
    return keyed.join(shared, "t", "left_semi")


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each line with a word: doc_id, text_hash, line, n_chars, removed (boolean)."""
    rows = written(_line_rows(docs, least_words), "lines")
    pos = F.struct("doc_id", "text_hash", "line")
    found = written(rows.groupBy("id").agg(F.min(pos).alias("pos"), F.first("halves").alias("halves")).select("id", F.xxhash64("id").alias("short"), "pos", "halves"), "entries")
    entries = found.select("id", "pos")
    firsts = found.where(F.size("halves") > 0).select("short", "pos")
    likely = _with_partner(found.select("short", F.explode("halves").alias("t"))).select("short").distinct()
    firsts = written(firsts.join(likely, "short", "left_semi"), "firsts")

    def keys(batches):
        """Keys in order: the line, then for each word the line without it, and the same with its place."""
        for b in batches:
            out = []
            for line in b.column(1).to_pylist():
                words = line.encode().split()
                mine = [_short(1, words)] if len(words) >= least_words - 1 else []
                for i in range(len(words) if len(words) >= least_words else 0):
                    less = words[:i] + words[i + 1 :]
                    bare = _short(1, less)
                    mine += [bare, _placed(bare, i)]
                out.append(mine)
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["short", "keys"])

    texts = written(_texts(docs, firsts), "likely")
    named = texts.join(firsts, "pos").select("short", "words")
    made = written(named.mapInArrow(keys, "short long, keys array<long>"), "variants")
    near = _with_partner(made.select("short", F.posexplode("keys").alias("at", "t")))
    near = near.select("t", "short", (F.col("at") % 2 == 0).alias("full")).distinct().join(firsts, "short")
    near = written(near.select("t", "full", "pos"), "keys")
    forget(made)
    # with one word replaced any two holders are the same; with one word added, a whole line and those with one word more
    least = near.groupBy("t").agg(F.min(F.when(F.col("full"), F.col("pos"))).alias("whole"), F.min(F.when(~F.col("full"), F.col("pos"))).alias("longer"))
    met = near.join(least, "t").select("pos", F.explode(F.filter(F.array(F.col("whole"), F.when(F.col("full"), F.col("longer"))), lambda p: p.isNotNull())).alias("lead")).where("lead < pos").distinct()
    a, b = texts.select("pos", F.col("words").alias("x")), texts.select(F.col("pos").alias("lead"), F.col("words").alias("y"))

    def check(batches):
        for batch in batches:
            good = [same_but_one(x.encode().split(), y.encode().split()) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0)], names=["pos"]).filter(pa.array(good, pa.bool_()))

    verified = met.join(a, "pos").join(b, "lead").select("pos", "x", "y").mapInArrow(check, f"pos {_POSITION}").distinct()
    gone = entries.join(verified, "pos", "left_semi").select("id").distinct().withColumn("near", F.lit(True))
    marked = rows.join(entries.select("id", "pos"), "id").join(gone, "id", "left")
    return marked.select("doc_id", "text_hash", "line", "n_chars", (F.coalesce("near", F.lit(False)) | (F.col("pos") < pos)).alias("removed"))


def line_report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, n_lines, n_removed, removed_lines, kept_chars (lines with a word only)."""
    rows = repeated_lines(docs, least_words)
    done = rows.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"),
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line")))).alias("removed_lines"),
        F.coalesce(F.sum(F.when(~F.col("removed"), F.col("n_chars"))), F.lit(0)).alias("kept_chars"),
    )
    # equal rows have equal lines: their counts are so many times those of one
    every = documents(docs).groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.count("*").alias("copies"))
    d, h = done.columns[:2]
    met = every.join(done.withColumnsRenamed({d: "d", h: "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    each = [F.expr(f"coalesce({c}, 0L) div copies").alias(c) for c in ("n_lines", "n_removed", "kept_chars")]
    return met.select("doc_id", "text_hash", *each[:2], F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), each[2])


def drop_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the removed lines cut out of text."""
    report = line_report(docs, least_words).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("removed_lines").alias("_gone"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    met = docs.join(report, docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_h")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return met.select(*[F.when(F.size("_gone") > 0, kept).otherwise(docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns])

"""Operator 7: token ids in a content-addressed store.

A text is encoded by the tokenizers library (each distinct piece of a slice
once: pieces end at white space and where its pre-tokenizer cuts for certain) and ends with the end id. A rolling
hash over WINDOW ids cuts the id stream of a document into chunks where the
content says so, so equal passages give equal chunks wherever they stand. The store
is a folder of four Parquet tables that only Spark writes and reads:

* chunks: sha256, n_ids, ids (little-endian, 2 bytes each where the vocabulary allows, else 4) - each distinct chunk once
* recipes: doc_id, start, n_tokens, chunks (the ordered sha256 of its chunks), in ascending doc_id order over the files
* manifest: level, node, n_children, sha256 - a Merkle tree over the sorted names of the chunks and hashes of the recipes; level 0 has the root
* format: one row with the version, bytes an id takes, end id

`read_back` first compares the root that the stored recipes and chunk names give with the manifest's, then checks every
chunk against its name: a recipe whose chunks were exchanged, left out or put in another order is found by its hash. The sum of a document is
combined from the sums of its chunks, so payloads are read once and never shuffled again.
`restore` gives the ids of the documents.

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id follow each other and each has its own start; null doc_ids come first; an
empty table gives an empty store with one root over nothing; a very long text is one recipe of many chunks; only doc_id and
text are read, so further columns may bear any name.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .store import documents, forget, fresh_path, partitions, remove, written

WINDOW = 16
MEAN_IDS = 512
LEAST_IDS = 64
MOST_IDS = 4096
END_ID = 1
#: ASCII letters 1, digits 2, signs 3 but ' and | (an ending may follow the one, a special string have the other); the rest 0.
_KIND = np.zeros(256, np.int8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = 3
#: Where the pre-tokenizer of the vocabulary always cuts between two ASCII characters.
_CUT = np.zeros((4, 4), bool)
_CUT[[1, 1, 2, 2, 2, 3, 3], [2, 3, 1, 2, 3, 1, 2]] = True
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of words by the library, remembered up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.at = B.LongMap(21)
        self.flat, self.off = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)
        self.n = 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if self.at.n + len(keys) > 1 << 20:
            self.at.clear()
            self.n = 0
        for lo in range(0, len(words), 10_000):
            got = [e.ids for e in self.library.encode_batch(words[lo : lo + 10_000], add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            new = np.fromiter((i for ids in got for i in ids), np.uint32, int(size.sum()))
            start = int(self.off[self.n])
            while start + len(new) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while self.n + len(got) + 1 > len(self.off):
                self.off = np.concatenate((self.off, np.zeros_like(self.off)))
            self.flat[start : start + len(new)] = new
            self.off[self.n + 1 : self.n + 1 + len(got)] = start + np.cumsum(size)
            self.at.put(keys[lo : lo + len(got)], np.arange(self.n, self.n + len(got)))
            self.n += len(got)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these rows and how many each row has."""
        if b"<|" not in data.tobytes():  # a special string is only one as it is spelt
            data = B.LOWER[data]
        kind = _KIND[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = _CUT[kind[:-1], kind[1:]]
        s, e = B.runs(~B.IS_SPACE[data], off, cut)
        row = np.searchsorted(off, s, "right") - 1
        h = B.mix(B.span_hash(B.prefix_hash(data), s, e) + (e - s).astype(B.U), 5)
        got = self.at.get(h)
        if (got < 0).any():
            miss = np.flatnonzero(got < 0)
            by = miss[np.argsort(h[miss], kind="stable")]
            one = np.concatenate(([True], h[by][1:] != h[by][:-1]))
            raw, pick = data.tobytes(), by[one]
            room = 1 << 19
            if len(pick) > room:  # more words than the memory holds: the row goes to the library as it is
                ids = [self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                return np.fromiter((i for x in ids for i in x), np.uint32), np.array([len(x) for x in ids], np.int64)
            before = self.n
            self._learn(h[pick], [raw[a:b].decode() for a, b in zip(s[pick].tolist(), e[pick].tolist())])
            got = self.at.get(h) if self.n < before + len(pick) else got
            got[by] = np.arange(self.n - len(pick), self.n)[np.cumsum(one) - 1]
            if (got < 0).any():  # the memory was cleared in between
                return self.encode(data, off)
        size = self.off[got + 1] - self.off[got]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.off[got] - (ends - size), size) + np.arange(total)]
        count = np.zeros(len(off) - 1, np.int64)
        np.add.at(count, row, size)
        return ids, count


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    n, out, last = len(ids), [], 0
    if n > WINDOW:
        h = B.prefix_hash(ids)
        at = np.arange(WINDOW, n)
        marks = at[B.mix(B.span_hash(h, at - WINDOW, at), 9) % B.U(MEAN_IDS) == 0].tolist()
    else:
        marks = []
    for m in [*marks, n]:
        while m - last > MOST_IDS:
            last += MOST_IDS
            out.append(last)
        if m - last >= LEAST_IDS or m == n and m > last:
            out.append(m)
            last = m
    return out


def _shift(crc: int, n_bytes: int) -> int:
    """What a crc32 becomes under n_bytes more bytes, before these are added."""
    zeros = bytes(n_bytes)
    return zlib.crc32(zeros, crc) ^ zlib.crc32(zeros, 0)


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encodes docs and writes the store; returns its folder. Without a path it is an intermediate table, which goes with the application."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "ids")

    def encode(batches):
        enc = encoder(tokenizer)
        kind = np.uint16 if enc.width == 2 else np.uint32
        for b in batches:
            data, off = B.utf8(b.column(1))
            for lo, hi in B.slices(off):
                ids, count = enc.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                names, payloads, sizes, at = [], [], [], 0
                for n in count.tolist():
                    one = np.append(ids[at : at + n], np.uint32(end_id))
                    at += n
                    last, got, raw, size = 0, [], [], []
                    for c in cuts(one):
                        part = one[last:c]
                        got.append(hashlib.sha256(part.astype("<u4").tobytes()).digest())
                        raw.append(part.astype(kind).tobytes())
                        size.append(c - last)
                        last = c
                    names.append(got)
                    payloads.append(raw)
                    sizes.append(size)
                yield pa.record_batch(
                    [b.column(0).slice(lo, hi - lo), pa.array(count + 1), pa.array(names, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(payloads, pa.list_(pa.binary()))],
                    names=["doc_id", "n_tokens", "chunks", "sizes", "ids"],
                )

    rows = documents(docs).mapInArrow(encode, "doc_id long, n_tokens long, chunks array<binary>, sizes array<int>, ids array<binary>")
    rows = written(rows, "encoded")
    each = rows.select(F.explode(F.arrays_zip("chunks", "sizes", "ids")).alias("c"))
    unique = each.groupBy(F.col("c.chunks").alias("sha256")).agg(F.first("c.sizes").alias("n_ids"), F.first("c.ids").alias("ids"))
    unique.write.option("compression", "zstd").parquet(f"{path}/chunks")
    _write_recipes(rows.select("doc_id", "n_tokens", "chunks"), f"{path}/recipes")
    forget(rows)
    _write_manifest(_leaves(spark, path), f"{path}/manifest")
    # the size of an id needs no second reading: a chunk says it
    width = F.max(F.expr("length(ids) div n_ids"))
    spark.read.parquet(f"{path}/chunks").agg(F.coalesce(width, F.lit(4)).cast("int").alias("id_bytes")).select(F.lit(1).alias("version"), "id_bytes", F.lit(end_id).alias("end_id")).write.parquet(f"{path}/format")
    return path


def _write_recipes(rows: DataFrame, to: str) -> None:
    """Running sums in doc_id order: ranges of doc_id, the sums of the ranges, then rows inside a range."""
    n = partitions(rows)
    ranged = written(rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("s"))
    before = F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "chunks").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # one row for each range: as many as there are shuffle partitions
    placed = placed.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "chunks")
    placed.repartitionByRange(n, "start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(to)
    forget(ranged)


def _write_manifest(nodes: DataFrame, to: str, fan_out: int = 256) -> None:
    """Each level names a node by two hexadecimal digits less, until one root is left."""
    n, digits = nodes.count(), 0
    while 16**digits * fan_out < n:
        digits += 2
    level = nodes.select("node", F.col("node").alias("sha256"))
    while True:
        level = level.groupBy(F.substring("node", 1, digits).alias("node")).agg(F.sort_array(F.collect_list("sha256")).alias("c"))
        level = level.select(F.lit(digits // 2).alias("level"), "node", F.size("c").cast("long").alias("n_children"), F.upper(F.sha2(F.array_join("c", ""), 256)).alias("sha256"))
        if not digits and not n:
            level = level.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit("").alias("node"), F.lit(0).cast("long").alias("n_children"), F.upper(F.sha2(F.lit(""), 256)).alias("sha256"))
        level.write.mode("append").parquet(to)
        if not digits:
            return
        level = level.sparkSession.read.parquet(to).where(F.col("level") == digits // 2).select("node", "sha256")
        digits -= 2


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    """(node): the names of the chunks, and of each recipe the hash of all that it says."""
    recipe = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("start").cast("string"), F.col("n_tokens").cast("string"), F.array_join(F.transform("chunks", F.hex), ","))
    recipes = spark.read.parquet(f"{path}/recipes").select(F.upper(F.sha2(recipe, 256)).alias("node"))
    return spark.read.parquet(f"{path}/chunks").select(F.hex("sha256").alias("node")).union(recipes)


def verify_manifest(spark: SparkSession, path: str, whole: bool = True) -> bool:
    """Whether the stored chunk names and recipes give the stored manifest; only its root unless whole."""
    again = fresh_path(spark, "manifest")
    _write_manifest(_leaves(spark, path), again)
    a, b = (spark.read.parquet(p).select("level", "node", "n_children", "sha256").where("true" if whole else "level = 0") for p in (again, f"{path}/manifest"))
    same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    remove(spark, again)
    return same


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    if not verify_manifest(spark, path, whole=False):
        raise ValueError("the recipes and chunk names do not give the root of the manifest")
    form = spark.read.parquet(f"{path}/format").first()
    kind = np.dtype("<u2" if form["id_bytes"] == 2 else "<u4")

    def sums(batches):
        for b in batches:
            names, payloads = b.column(0).to_pylist(), b.column(1)
            crc, size = [], []
            for name, raw in zip(names, payloads):
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4").tobytes()
                if hashlib.sha256(ids).digest() != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                crc.append(zlib.crc32(ids))
                size.append(len(ids) // 4)
            yield pa.record_batch([b.column(0), pa.array(crc, pa.int64()), pa.array(size, pa.int64())], names=["sha256", "crc", "n"])

    def combine(batches):
        for b in batches:
            out, total = [], []
            for parts in b.column(3).to_pylist():
                crc = n = 0
                for p in sorted(parts, key=lambda p: p["at"]):
                    crc = _shift(crc, 4 * p["n"]) ^ p["crc"]
                    n += p["n"]
                out.append(crc)
                total.append(n)
            if total != b.column(2).to_pylist():
                raise ValueError("a recipe and its chunks differ in length")
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = spark.read.parquet(f"{path}/chunks").select("sha256", "ids").mapInArrow(sums, "sha256 binary, crc long, n long")
    parts = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", F.posexplode("chunks").alias("at", "sha256"))
    met = parts.join(chunks, "sha256", "left").groupBy("doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("at", F.coalesce("crc", F.lit(-1)).alias("crc"), F.coalesce("n", F.lit(0)).alias("n"))).alias("parts"))
    return met.select("doc_id", "start", "n_tokens", "parts").mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>): the documents themselves."""
    form = spark.read.parquet(f"{path}/format").first()
    kind = np.dtype("<u2" if form["id_bytes"] == 2 else "<u4")

    def join(batches):
        for b in batches:
            ids = [np.concatenate([np.frombuffer(p["ids"], kind) for p in sorted(parts, key=lambda p: p["at"])]).astype(np.int32) for parts in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    parts = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("chunks").alias("at", "sha256"))
    met = parts.join(spark.read.parquet(f"{path}/chunks").select("sha256", "ids"), "sha256").groupBy("doc_id", "start").agg(F.collect_list(F.struct("at", "ids")).alias("parts"))
    return met.mapInArrow(join, "doc_id long, start long, ids array<int>")

"""Operator 1: exact Jaccard join on word shingles with several global token orders.

Texts with equal shingle sets form a class, found by a 128-bit digest of the
set; everything after works on one set for each class. Under any total order of
the tokens, two sets of similarity >= s share a token among their first
n - ceil(s * n) + 1 tokens. Three orders are used:

* A: tokens by how common they are (counts over all documents, the common ones
  last), ties by hash. Its prefix lists make the candidates.
  A candidate must share so many prefix tokens that the rest can make up what is missing.
* A bitmap of SIGNATURE bits holds the parity of how many tokens of the set fall on each bit. Two sets differ in at
  least as many tokens as their bitmaps in bits, so pairs that differ in too many never leave the join of lists.
* B and C: two seeded hash orders. The pairs that order A leaves are joined with their B and
  C prefixes alone; a pair that lacks a common token in either is dropped. Whole
  sets are read only for the pairs that pass all three.

Only one row of each class makes lists, so copies cost nothing there; lists are
joined and grouped by Spark, so a token that very many sets share is combined
before the shuffle or split as a skewed join, never gathered in one task. Pairs and sets
meet by merge joins at every size, since either side grows with the input.

Candidates from a list are not all its pairs. First each member of a list is
compared with one leader, the member with most common tokens in its prefix.
Members that this links are one component and need no further comparison with
each other. Then the remaining pairs of a list - those in different
components that the length and position filters allow - are compared, all of
them. So components are exact, while a group of ten thousand near copies costs
ten thousand comparisons. Counting the links inside such a component would cost
its square, so links are not counted; class ids and sizes are returned instead.

Defined cases: a null or word-less text has an empty set and no links; a
text with fewer words than a shingle is one shingle; rows that repeat a doc_id
are one node for each distinct set; a row with a null doc_id is returned
with its size and a null component and links nothing; an empty table gives an empty
result; of equal sets the least doc_id names the class; a very long text is
one set like any other; only doc_id and text are read, so further columns may bear
any name. Shingles are 64-bit hashes of their words: two different shingles of one
pair are taken for equal with a probability of about n*n / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .components import connected_components
from .store import documents, forget, free_name, sieved, written

#: Tokens that order A knows as common: a bound on what is broadcast, not on what is compared.
MOST_COMMON = 1 << 16
#: A token counts as common from so many documents of one batch of input rows.
COMMON_IN_BATCH = 4
#: Bits of a set's bitmap.
SIGNATURE = 256
#: Sets leave Python in batches of about so many tokens.
SET_TOKENS = 1 << 18


def token_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    data, off = B.utf8(texts)
    for lo, hi in B.slices(off):
        h, n = B.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        ends = np.cumsum(n)
        starts = ends - n
        k = max(0, len(h) - words + 1)
        grams = np.zeros(k, B.U)
        for j in range(words):
            grams = B.mix(grams ^ h[j : j + k], j + 1)
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s >= words:
                g = np.sort(grams[s : e - words + 1])
                yield g[np.concatenate(([True], g[1:] != g[:-1]))]
            elif e > s:
                x = np.array([e - s], B.U)
                for j in range(s, e):
                    x = B.mix(x ^ h[j : j + 1], 77)
                yield x
            else:
                yield np.zeros(0, B.U)


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens on SIGNATURE bits, as 64-bit numbers."""
    odd = np.bincount((tokens >> B.U(17)).astype(np.int64) & (SIGNATURE - 1), minlength=SIGNATURE).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1 if n else 0


def in_order(tokens: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """The prefix of a set under a seeded hash order, as 32 bits of each key: equal tokens stay equal."""
    p = prefix_length(len(tokens), percent)
    keys = B.mix(tokens, seed)
    return (np.sort(keys)[:p] if p < len(keys) else keys).astype(np.uint32).view(np.int32)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.concatenate(arrays)))


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    def count(batches):
        for b in batches:
            sets = list(token_sets(b.column(0), words))
            t = np.concatenate(sets) if sets else np.zeros(0, B.U)
            del sets
            t.sort()
            k = COMMON_IN_BATCH - 1
            often = B.distinct(t[k:][t[k:] == t[: len(t) - k]]) if len(t) > k else t[:0]
            n = np.searchsorted(t, often, "right") - np.searchsorted(t, often, "left")
            yield pa.record_batch([pa.array(often.view(np.int64)), pa.array(n.astype(np.int64))], names=["t", "n"])

    rows = docs.select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "t").limit(MOST_COMMON).toArrow()
    t, n = top.column("t").to_numpy().view(B.U), top.column("n").to_numpy()
    by = np.argsort(t)
    return t[by], n[by]


def shingle_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, key, n, digest, tokens, bits): text hash, size, digest, order-A prefix and bitmap of each document's set."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, words))

    def sets(batches):
        t, count = common.value
        for b in batches:
            done, size, digest, prefixes, bits, held = 0, [], [], [], [], 0
            for i, g in enumerate(token_sets(b.column(2), words)):
                p = prefix_length(len(g), percent)
                if len(t) and len(g):
                    at = np.minimum(np.searchsorted(t, g), len(t) - 1)
                    often = np.where(t[at] == g, count[at], 0)
                    g_a = g[np.lexsort((g, often))] if often.any() else g
                else:
                    g_a = g
                size.append(len(g))
                digest.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                prefixes.append(g_a[:p].view(np.int64).copy())
                bits.append(signature(g))
                held += p
                if held >= SET_TOKENS or i == b.num_rows - 1:
                    columns = [b.column(0).slice(done, len(size)), b.column(1).slice(done, len(size)), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists(prefixes), lists(bits)]
                    yield pa.record_batch(columns, names=["doc_id", "key", "n", "digest", "tokens", "bits"])
                    done, size, digest, prefixes, bits, held = i + 1, [], [], [], [], 0

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(sets, "doc_id long, key long, n long, digest binary, tokens array<long>, bits array<long>")


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose order-A prefixes have enough in common: beyond them the sets can share at most what either has left."""
    pairs = written(pairs, "candidates")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    likely = sieved(nodes.select("cid", "n", "tokens"), involved, "cid")
    prefixes = written(likely.join(involved.hint("merge"), "cid", "left_semi"), "prefixes")
    x = prefixes.select(F.col("cid").alias("a"), F.col("n").alias("n"), F.col("tokens").alias("x"))
    y = prefixes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    most = F.size(F.array_intersect("x", "y")) + F.greatest(F.col("n") - F.size("x"), F.col("m") - F.size("y"))
    most = F.least(most, F.col("n"), F.col("m"))
    enough = (F.lit(100) * most >= F.lit(percent) * (F.col("n") + F.col("m") - most)) & (F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m"))
    close = written(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(enough).select("a", "b"), "pairs")
    forget(pairs, prefixes)
    return close


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, repeats: bool, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: the prefixes of both hash orders must meet, then whole sets are compared,
    pair by pair inside Spark, so that no task holds the sets of many pairs at once."""

    def whole(batches):
        for b in batches:
            done, held, size = 0, [], 0
            for i, g in enumerate(token_sets(b.column(1), words)):
                held.append(g)
                size += len(g)
                if size >= SET_TOKENS or i == b.num_rows - 1:
                    columns = [b.column(0).slice(done, len(held)), lists([g.view(np.int64) for g in held]), *(lists([in_order(g, seed, percent) for g in held]) for seed in (101, 202))]
                    yield pa.record_batch(columns, names=["cid", "set", "by_b", "by_c"])
                    done, held, size = i + 1, [], 0

    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.select(F.col("cid").alias("node"), F.col("lead.doc_id").alias("doc_id"), F.col("lead.key").alias("key")).join(involved, "node", "left_semi")
    wanted = written(wanted, "wanted")
    own = sieved(texts, wanted, "doc_id", "key").join(wanted.hint("merge"), ["doc_id", "key"])
    if repeats:
        own = own.groupBy("node").agg(F.first("text").alias("text"))
    sets = written(own.select("node", "text").mapInArrow(whole, "cid long, set array<long>, by_b array<int>, by_c array<int>"), "whole")
    left = sets.select(F.col("cid").alias("a"), F.col("by_b").alias("x_b"), F.col("by_c").alias("x_c"))
    right = sets.select(F.col("cid").alias("b"), F.col("by_b").alias("y_b"), F.col("by_c").alias("y_c"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(F.arrays_overlap("x_b", "y_b") & F.arrays_overlap("x_c", "y_c"))
    met = written(met.select("a", "b"), "met")
    both = F.size(F.array_intersect("x", "y"))
    linked = F.lit(100 + percent) * both >= F.lit(percent) * (F.size("x") + F.size("y"))
    x, y = (sets.select(F.col("cid").alias(c), F.col("set").alias(s)).hint("merge") for c, s in (("a", "x"), ("b", "y")))
    sides = met.join(x, "a").join(y, "b")
    links = written(sides.where(linked).select("a", "b"), "links")
    forget(sets, met, wanted)
    return links


def _possible(percent: int, n, i, m, j):
    """Length and position filters: a first common token at i of n and j of m allows at most this overlap."""
    most = F.lit(1) + F.least(n - i, m - j) - F.lit(1)
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100) * most >= F.lit(percent) * (n + m - most))


def _alike(percent: int):
    """Bitmap filter: linked sets differ in (100 - percent) / (100 + percent) of their tokens at most."""
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(SIGNATURE // 64)), F.lit(0))
    return F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("n") + F.col("m"))


def _links(nodes: DataFrame, texts: DataFrame, repeats: bool, words: int, percent: int) -> DataFrame:
    """(node, component) over the links between the sets of nodes (cid, lead, n, tokens, bits), one row each; texts has (doc_id, key, text), with repeats if rows may be equal."""
    # the tokens that two sets have in their prefixes: counts are combined before the shuffle, the join splits hot tokens
    listed = nodes.select("cid", "n", F.posexplode("tokens").alias("at", "t"))
    shared = listed.groupBy("t").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("t")
    kept = written(listed.join(shared, "t", "left_semi"), "lists")
    # the leader of a list: the set with most shared tokens in its prefix
    weight = kept.groupBy("cid").agg(F.count("*").alias("w"))
    weighed = kept.join(weight, "cid")
    leaders = weighed.groupBy("t").agg(F.max(F.struct("w", (-F.col("cid")).alias("c"), "n", "at")).alias("l")).select("t", (-F.col("l.c")).alias("lead"), F.col("l.n").alias("m"), F.col("l.at").alias("j"))
    first = kept.join(leaders, "t").where("cid <> lead").where(_possible(percent, F.col("n"), F.col("at"), F.col("m"), F.col("j")))
    first = first.select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")).distinct()
    first = _close(first, nodes, percent)
    links = _verified(first, nodes, texts, repeats, words, percent)
    group = connected_components(links)
    # what the leaders left open: lists that hold sets of two components, and there only pairs of different components
    placed = kept.join(group.withColumnRenamed("node", "cid"), "cid", "left").select("t", "cid", "n", "at", F.coalesce("component", "cid").alias("g"))
    open_lists = placed.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("t")
    placed = placed.join(open_lists, "t", "left_semi").join(nodes.select("cid", "bits").hint("merge"), "cid")
    placed = written(placed, "open")
    # within a list, the shorter side needs only the shorter index prefix
    short = (F.lit(100 + percent) * (F.col("n") - F.col("at"))) >= F.lit(2 * percent) * F.col("n")
    y = placed.select("t", F.col("cid").alias("cid2"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("g").alias("g2"), F.col("bits").alias("bits2"))
    rest = placed.where(short).join(y, "t").where("g <> g2 and (n < m or (n = m and cid < cid2))").where(_possible(percent, F.col("n"), F.col("at"), F.col("m"), F.col("j")) & _alike(percent))
    rest = rest.select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    rest = _close(rest, nodes, percent)
    more = _verified(rest, nodes, texts, repeats, words, percent)
    every = written(more.union(links), "links")
    components = connected_components(every)
    forget(kept, first, placed, rest, links, more, every)
    return components


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, key, n, cid, class_size, component, lead) of each row: lead is true for the rows that stand for their component."""
    base = documents(docs)
    rows = written(shingle_rows(base, words, percent), "sets")
    full = rows.where("doc_id is not null and n > 0")
    least = F.min(F.struct("doc_id", "key"))
    classes = written(full.groupBy("digest").agg(least.alias("lead"), F.count("*").alias("class_size"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits")), "classes")
    nodes = classes.withColumn("cid", F.col("lead.doc_id"))
    # two sets under one least doc_id are two nodes: the second is known by its digest
    twice = written(nodes.groupBy("cid").agg(F.min("digest").alias("one"), F.count("*").alias("k")).where("k > 1").select("cid", "one"), "twice")
    if not twice.isEmpty():
        by_set = F.lit(1 << 62) + F.pmod(F.xxhash64("digest"), F.lit(1 << 62))
        nodes = nodes.join(twice, "cid", "left").withColumn("cid", F.when(F.col("one") != F.col("digest"), by_set).otherwise(F.col("cid")))
    slim = written(rows.select("doc_id", "key", "n", "digest"), "rows")
    forget(rows)
    repeats = not slim.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    texts = base.select("doc_id", F.xxhash64("text").alias("key"), "text")
    components = _links(nodes, texts, repeats, words, percent)
    placed = nodes.join(components.withColumnRenamed("node", "cid"), "cid", "left").select("digest", "lead", "class_size", "cid", F.coalesce("component", "cid").alias("component"))
    placed = written(placed, "placed")
    forget(classes, twice)
    # a component that holds only second sets is named by the least doc_id among them
    unnamed = written(placed.where(F.col("component") >= F.lit(1 << 62)).groupBy("component").agg(F.min("lead.doc_id").alias("name")), "unnamed")
    by_class = placed.withColumn("name", F.lit(None).cast("long")) if unnamed.isEmpty() else placed.join(unnamed, "component", "left")
    by_class = by_class.select("digest", F.col("lead").alias("l"), "class_size", (F.col("cid") == F.col("component")).alias("leads"), F.coalesce("name", "component").alias("component"))
    known = slim.where("doc_id is not null and n > 0").join(by_class, "digest")
    known = known.select("doc_id", "key", "n", F.col("l.doc_id").alias("cid"), "class_size", "component", (F.col("leads") & (F.col("doc_id") == F.col("l.doc_id")) & (F.col("key") == F.col("l.key"))).alias("lead"))
    alone = slim.where("doc_id is null or n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("cid"), F.lit(1).cast("long").alias("class_size"), F.col("doc_id").alias("component"), F.lit(True).alias("lead"))
    return known.union(alone)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id (least doc_id with the same set),
    class_size (rows with the same set), component_id (least doc_id reachable over links of
    100 * intersection >= percent * union)."""
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("percent in 1..100 and words >= 1")
    found = _grouped(docs, words, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), "class_size", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component; every row is judged for itself. A row without a doc_id joins its group
    by a stand-in id made of its text, above 2**62, so that a row with a doc_id below that stays before it. Of rows with
    equal doc_id and text one stays. Texts without words have no group: of their equal rows one stays too."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    row_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 62)))
    found = written(_grouped(docs.select(row_id.alias("doc_id"), text.alias("text")), words, percent).select("doc_id", "key", "lead"), "judged")
    gone = found.where(~F.col("lead")).select("doc_id", "key").distinct()
    again = written(found.where("lead").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeated")
    row, mark = free_name(docs, "_row"), free_name(docs, "_mark")
    named = lambda d: d.select(F.col("doc_id").alias(row), F.col("key").alias(mark))
    same = lambda d: (row_id == d[row]) & (F.xxhash64(text) == d[mark])
    marks = named(gone.union(again))
    kept = docs.join(marks, same(marks), "left_anti").select(docs.columns)
    if again.isEmpty():
        return kept
    repeated = named(again)
    one = docs.join(repeated, same(repeated)).dropDuplicates([row, mark]).select(docs.columns)
    return kept.union(one)

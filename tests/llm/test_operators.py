import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lekhaspark.llm import decontaminate, html_text, jaccard, lines, mixing, prefix_tokens, quality, queries, substrings, token_store, toxicity

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, times int, id string, n long, key long, g long, r long, t long, a int, b int, bucket string, text_hash string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, further columns with names that operators use."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3
    rest = ("x", 1, "i", 1, 1, 1, 1, 1, 1, 1, "b", "h")
    rows = [
        (1, same, "en", "s", 1, *rest), (1, same, "en", "s", 1, *rest), (2, same, None, None, None, *[None] * 12), (3, None, "en", "s", 0, *rest),
        (4, "", "en", "s", 0, *rest), (5, " \n\t ", "en", "s", 4, *rest), (6, long, "en", "t", 9, *rest), (None, same, "en", "s", 1, *rest), (None, None, None, None, None, *[None] * 12),
        (7, "one", "en", "s", 3, *rest), (8, "naïve ΟΔΟΣ 漢字 \U0001F600 <|endoftext|> it's", "en", "u", 3, *rest), (9, long, "en", "t", 9, *rest),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def shingles(text, k):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, percent):
    sets, parent, seen = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in seen[s]:
                shared[j] += 1
            seen[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(n, seed):
    rng, base = random.Random(seed), [f"w{i}" for i in range(120)]
    out = {}
    for i in range(n):
        w = list(base) if i % 3 else [f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
        out[i + 10] = " ".join(w)
    return out


def test_jaccard_equals_brute_force(spark, docs):
    made = near_copies(150, 4)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    for source, texts, k, p in ((df, made, 5, 80), (docs, {r["doc_id"]: r["text"] for r in docs.collect()}, 4, 85)):
        got = {r[0]: (r[1], r[2]) for r in rows_of(jaccard.jaccard_components(source, k, p), "doc_id", "n_shingles", "component_id")}
        assert got == brute_components(texts, k, p)


def test_jaccard_edges(spark, edges):
    got = rows_of(jaccard.jaccard_components(edges, 4, 85), "doc_id", "n_shingles", "component_id")
    assert len(got) == 12 and (2, 10, 1) in got and (9, got[-1][1], 6) in [(a, got[-1][1], c) for a, b, c in got] and (3, 0, 3) in got and (7, 1, 7) in got
    # one row of each group stays: the repeated row of 1 and the copy without a doc_id go
    kept = jaccard.keep_one(edges)
    assert kept.columns == edges.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]


def test_jaccard_large_groups(spark):
    """A group of exact copies and one of near copies, each a third of all rows: two components, whatever their size."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in (rng.randrange(300) for _ in range(4000))]
    rest = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4000)]
    texts = [(k, t) for k, t in enumerate(["the same text of ten words, again and again, here"] * 4000 + near + rest)]
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string").repartition(12), 5, 80).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == {k: 0 if k < 4000 else 4000 if k < 8000 else k for k in range(12000)}
    assert got[17]["class_size"] == 4000 and got[17]["class_id"] == 0


def test_jaccard_rows_that_share_an_id(spark):
    """Two texts under one doc_id are two nodes: neither goes for the other's copy."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (9, b)], "doc_id long, text string")
    assert rows_of(jaccard.jaccard_components(df), "doc_id", "class_id", "component_id") == [(1, 1, 1), (5, 1, 1), (5, 5, 5), (5, 5, 5), (9, 5, 5)]
    assert rows_of(jaccard.keep_one(df), "doc_id", "text") == [(1, a), (5, b)]


def test_quality(spark, edges, docs):
    got = rows_of(quality.quality(edges), "doc_id", "n_words", "base_failed", "kept")
    # the second half of the long text repeats its first
    assert len(got) == 12 and (4, 0, True, False) in got and (6, 60000, True, False) in got
    assert quality.keep_good(edges).columns == edges.columns
    marked = quality.quality(docs).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed")
    assert marked.where((F.col("quality") == 1) != F.col("kept")).count() <= 2


def test_mixing(spark, edges, docs):
    got = mixing.mix(docs)
    by = got.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r["k"] - r["t"]) <= 3 * r["m"] for r in by)
    assert got.where("taken > 3 * size").count() == 0
    assert mixing.mix(edges).count() == 12
    taken = mixing.take_mix(edges)
    assert taken.columns == edges.columns and taken.count() == mixing.mix(edges).agg(F.sum("times")).first()[0]


def test_html():
    page = """<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><a href=x>menu</a></nav><div class="cookie-notice">cookies, yes, all</div>
    <div id=content><h1>Head &amp; more</h1><p>First paragraph, with commas, and a   long
    line of text that counts.<p>Second &lt;one&gt; with <a href=y>a link</a>, fine.<form><p>mail me</form></div><div class=comments><p>I think, well, no, never, ever.</div>
    <aside><p>side, side, side</aside><footer>&copy; me</footer>"""
    assert html_text.main_text(page) == "Head & more\nFirst paragraph, with commas, and a long line of text that counts.\nSecond <one> with a link, fine."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<!-- x", "plain")] == ["", "", "", "", "plain"]


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>"), (None, None, None)], "page_id long, url string, html string")
    assert rows_of(html_text.extract(pages), "page_id", "text", "n_chars") == [(1, "a b", 3), (None, "", 0)]


def test_token_counts_equal_library(spark, docs, edges):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    for df in (docs, edges):
        got = prefix_tokens.token_prefixes(df.select("doc_id", "text"), PATH)
        want = [(r["doc_id"], len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect()]
        assert rows_of(got, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    word = b"counterrevolutionary"
    found = prefix_tokens.prefix_counts(prefix_tokens.model(PATH), np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    assert found.tolist() == [len(lib.encode(word[:i].decode(), add_special_tokens=False).ids) for i in range(1, len(word) + 1)]
    one = prefix_tokens.fit(prefix_tokens.token_prefixes(docs, PATH), 20).first()
    text = docs.where(F.col("doc_id") == one["doc_id"]).first()["text"]
    assert len(lib.encode(text[: one["fit_end"]], add_special_tokens=False).ids) <= 20


def brute_strings(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone, new = bytearray(len(b)), []
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
            else:
                new.append(b[k : k + 50])
        seen.update(dict.fromkeys(new, i))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(gone[z] and (z == 0 or not gone[z - 1]) for z in range(len(b))), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, docs, edges):
    rng, base = random.Random(3), "".join(random.Random(9).choice("abé ") for _ in range(900))
    made = {i: base[a : a + n] + str(i) * rng.randrange(9) + base[c : c + 70] for i in range(60) for a, n, c in [(rng.randrange(800), rng.randrange(200), rng.randrange(800))]}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    for source, texts in ((df, made), (docs, {r["doc_id"]: r["text"] for r in docs.collect()})):
        got = substrings.repeated_strings(source).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
        assert {r[0]: tuple(r[1:]) for r in got} == brute_strings(texts)
    got = {r[0]: r[1] for r in rows_of(substrings.repeated_strings(edges).where("doc_id is not null"), "doc_id", "n_removed")}
    assert got[1] == 0 and got[2] == 174 and got[6] == 0 and got[9] > 100_000 and got[3] == 0


def brute_lines(rows, least):
    """(doc_id, n_lines, removed) of each distinct row, by comparing every line with all that stand before it."""
    placed = sorted({(d, t) for d, t in rows}, key=lambda r: r[0])
    seen, out = [], []
    for d, t in placed:
        removed, n = [], 0
        for at, line in enumerate(t.split("\n")):
            w = line.encode().split()
            if w:
                n += 1
                if any(w == x or max(len(w), len(x)) >= least and lines.same_but_one(w, x) for x in seen):
                    removed.append(at)
                seen.append(w)
        out.append((d, n, removed))
    return out


@pytest.mark.parametrize("least", [8, 3])
def test_lines_equal_brute_force(spark, least):
    """Lines of a small vocabulary, copies with words changed, added and left out, and repeated rows."""
    rng = random.Random(least)
    made = [[rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    for _ in range(200):
        w = list(rng.choice([x for x in made if x]))
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = rng.choice(([], ["z"], ["y", "z"]))
        made.append(w)
    rows = [(d, "\n".join(" ".join(rng.choice(made)) for _ in range(rng.randrange(1, 6)))) for d in range(150)]
    rows += [rows[3], rows[3], rows[70]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_lines"], r["removed_lines"]) for r in lines.line_report(df, least).orderBy("doc_id").collect()]
    assert got == brute_lines(rows, least) and any(r for _, _, r in got)


def test_lines(spark, edges):
    a = "the quick brown fox jumps over the lazy dog today"
    rows = [(1, f"{a}\nshort line"), (2, f"{a.replace('lazy', 'idle')}\nshort line\nshort lines"), (3, f"{a} again\n\n{a.replace('fox ', '')}"), (4, "the slow brown fox leaps over the lazy dog today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(lines.line_report(df), "doc_id", "n_lines", "removed_lines") == [(1, 2, []), (2, 3, [0, 1]), (3, 2, [0, 2]), (4, 1, [])]
    assert lines.drop_lines(df).where("doc_id = 2").first()["text"] == "short lines"
    assert lines.line_report(edges).where("doc_id in (3, 4, 5)").agg(F.sum("n_lines")).first()[0] == 0


def test_store_round_trip(spark, docs, edges):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    for df in (docs, edges):
        path = token_store.write_store(df, PATH)
        want, at = [], 0
        for r in sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] is not None)):
            ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            want.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        back = token_store.read_back(spark, path)
        assert rows_of(back, "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=repr)
        starts = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in back.collect())
        assert [s for s, _, _ in starts] == [0, *np.cumsum([n for _, n, _ in starts])[:-1].tolist()] and [d for _, _, d in starts] == sorted(d for _, _, d in starts)
        assert token_store.verify_manifest(spark, path)
        assert all(len(r["ids"]) == r["n_tokens"] for r in token_store.restore(spark, path).join(back.drop("start"), "doc_id").where("doc_id is not null and doc_id <> 1").collect())


def test_toxicity(spark, edges):
    words = [f"word{i}" for i in range(300)]
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = rng.sample(words, 30) + ([rng.choice(["idiot", "m0ron", "іdiot"])] if bad else [])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(toxicity.labelled(d, l.where(~toxicity.held_out(F.col("doc_id")))))
    got = toxicity.score(d, model).join(l, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    assert got.where("predicted <> toxic").count() <= 0.02 * got.count()
    assert toxicity.score(edges, model).where("score between 0 and 1").count() == 12
    assert toxicity.learn(toxicity.labelled(d, l.limit(0))).lexicon == {}
    assert toxicity.fold("1D10T, i d i o t!") == " idiot idiot "


def test_toxicity_exceptions():
    m = toxicity.Model({" trash ": 5.0}, [" trash can "]).compile()
    assert m.evidence(" a trash can ")[1] == [] and m.evidence(" a trash ")[0] > 4


def test_decontamination(spark, docs, edges):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in r["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}
    assert want <= got and len(got - want) <= 1
    nulls = bench.union(spark.createDataFrame([(None, "x"), (99999, None), (99998, "")], "item_id long, text string"))
    assert decontaminate.find(edges, nulls).count() == 0 and decontaminate.clean(edges, bench.limit(0)).count() == 12
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard.jaccard_components(none).count() == quality.quality(none).count() == mixing.mix(none).count() == substrings.repeated_strings(none).count() == lines.line_report(none).count() == 0
    path = token_store.write_store(none, PATH)
    assert token_store.read_back(spark, path).count() == 0 and token_store.verify_manifest(spark, path)


def test_pipeline_equals_brute_force(spark, docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(quality.sql(least_words=1)).fetchall() if r[7]}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in kept}
    alone = {i for i, (_, c) in brute_components({i: r["text"] for i, r in rows.items()}, 5, 80).items() if c == i}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted(i for i in alone if not any(t in rows[i]["text"] for t in items))
    con.execute("drop view documents")
    con.register("documents", docs.where(F.col("doc_id").isin(clean)).toPandas())
    times = {i: taken // size for i, size, _, _, taken in con.execute(mixing.sql()).fetchall() if taken}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, k in times.items() for _ in range(k))
    assert len(corpus_pipeline.STAGES) == 5

import hashlib
import math
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lekhaspark.llm import byte_words, decontaminate, fingerprints, importance, queries, toxicity, treap
from lekhaspark.llm.html_text import main_text

SF = "/root/testdata/sf0.001"
PROSE = "The quick brown fox, jumping over lazy dogs, tells a long story about it. " * 3


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, further columns with names that operators use."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, "alpha beta. gamma\ndelta"), (1, "alpha beta. gamma\ndelta"), (1, "other text"), (2, None), (3, ""), (4, long), (5, "naïve ΟΔΟΣ 漢字 \U0001F600 it's"), (None, "alpha"), (None, None), (6, "alpha " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' as h", "1 as bucket", "2 as kind", "3 as rank", "4 as score", "5 as n", "6 as item_id", "7 as weight", "8 as part")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def cut(text):
    """Words by the definition: no ASCII characters but letters and digits."""
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in lower(text)).split(" ")


def brute_resample(docs, bench):
    def features(text):
        w = [x for x in cut(text) if x]
        return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)

    count = lambda texts: [zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[0]]
    corpus, target = count([t for _, t in docs]), count(bench)
    s, t = [0] * 10000, [0] * 10000
    for b in corpus:
        s[b] += 1
    for b in target:
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (len(corpus) + 10000) / ((s[k] + 1) * (len(target) + 10000)))) for k in range(10000)]
    rows, likely = [], []
    for i, text in docs:
        f, n = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            likely.append(rows[-1])
    likely.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(likely[: 5 * len(likely) // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows), key=repr)


def test_importance_resampling(tables):
    docs, bench = tables
    want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()])
    got = sorted((tuple(r) for r in queries.op11_importance_resampling(docs.sparkSession, SF).collect()), key=repr)
    assert got == want and sum(r[4] is not None for r in got) == 9
    drawn = importance.take_sample(docs, bench)
    assert drawn.columns == docs.columns and drawn.count() == 9


def test_importance_edges(odd, tables, spark):
    bench = tables[1]
    many = odd.union(odd).union(odd)
    texts = [(r["doc_id"], r["text"]) for r in many.collect()]
    got = sorted((tuple(r) for r in importance.resample(many, bench, percent=50).collect()), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in brute_resample(texts, [r["text"] for r in bench.collect()])]
    assert sorted(g[4] for g in got if g[4]) == [1, 2, 3] and importance.resample(odd.limit(0), bench).count() == 0
    assert importance.resample(odd, bench.limit(0)).count() == 10
    assert byte_words.words("It's naïve, A-1") == ["it".encode(), b"s", "naïve".encode(), b"a", b"1"]


def brute_rank(docs, items):
    words = {k: [w for w in cut(t) if w] for k, (_, t) in enumerate(docs)}
    n_docs, total = sum(bool(w) for w in words.values()), sum(map(len, words.values()))
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, text in items:
        hits = []
        for k, (d, _) in enumerate(docs):
            score = 0
            for t in {w for w in cut(text) if w}:
                tf = words[k].count(t)
                if tf:
                    m = 10 + 90 * len(words[k]) * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0 and d is not None:
                hits.append((-score, d))
        out += [(i, k, d, -s) for k, (s, d) in enumerate(sorted(hits)[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_bytes", [1, 3000, 1 << 20])
def test_ranked_search(spark, slice_bytes):
    rng = random.Random(slice_bytes)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    docs = [(k if k % 17 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for k in range(150)] + [(7, "w1 w2 w3")] * 25 + [(300 + k, "w1 w2 w3") for k in range(25)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for k in range(25)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items + [(99, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in treap.rank(*frames, slice_bytes=slice_bytes).collect())
    assert got == brute_rank(docs, items)


def test_ranked_search_in_parts(tables, monkeypatch):
    docs, bench = tables
    whole = sorted(map(tuple, treap.rank(docs, bench).collect()))
    monkeypatch.setattr(treap, "PART_WORDS", 300)
    monkeypatch.setattr(treap, "ROWS", 20)
    monkeypatch.setattr(treap, "WIDTH", 2)
    assert sorted(map(tuple, treap.rank(docs, bench).collect())) == whole


def test_ranked_search_edges(odd, spark):
    items = spark.createDataFrame([(1, "ALPHA beta"), (1, "gamma"), (2, None), (3, ""), (None, "alpha"), (4, "nowhere"), (5, "漢字")], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as term")
    rows = treap.rank(odd, items).collect()
    assert {r["item_id"] for r in rows} == {1, 5} and [r["doc_id"] for r in rows if r["item_id"] == 5] == [5]
    first = sorted((r["rank"], r["doc_id"]) for r in rows if r["item_id"] == 1)
    assert first[:2] == [(1, 1), (2, 1)] and len(first) == 3
    assert treap.rank(odd.limit(0), items).count() == 0 and treap.rank(odd, items.limit(0)).count() == 0


def likeness(a, b):
    a, b = (set(fingerprints.paragraphs([x])[1].tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(tables):
    docs = tables[0]
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in queries.op13_fingerprints(docs.sparkSession, SF).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(text, edited)) < 1e-12 and abs(r["near_next"] - likeness(text, after)) < 1e-12
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(prints.values())) == len(prints)


def test_changes_are_recovered(spark):
    base = [f"Paragraph {k} says something of its own about {k * k}.\n" for k in range(600)]
    versions = [(1, base, base), (2, base, base[:300] + ["New.\n"] + base[301:]), (3, base, base[::2]), (4, base, ["Nothing of it.\n"]), (5, [], []), (6, base[:1] * 5, base[:1] * 3), (7, [], base)]
    df = spark.createDataFrame([(i, "".join(a), "".join(b)) for i, a, b in versions] + [(8, None, "x")], "id long, old string, new string")
    got = {r["id"]: r for r in fingerprints.changes(df).collect()}
    for i, a, b in versions:
        old, new = (set(fingerprints.paragraphs(["".join(x)])[1].view("int64").tolist()) for x in (a, b))
        assert set(got[i]["removed"]) == old - new and set(got[i]["added"]) == new - old
    assert got[1]["near"] == 1.0 and got[1]["cells"] == fingerprints.CELLS < got[3]["cells"] and got[5]["near"] == 1.0 and len(got[6]["removed"]) == 2 * len(fingerprints.paragraphs([base[0]])[1])
    assert got[8]["near"] == 0.0


def test_next_versions_edges(odd, spark):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    got = fingerprints.next_versions(odd).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    one = fingerprints.next_versions(odd.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0 and fingerprints.next_versions(odd.limit(0)).count() == 0
    # a third of all rows are equal: each but one is followed by its equal
    hot = spark.createDataFrame([(5, PROSE)] * 60 + [(k, f"text {k}. And more of it, {k} times.") for k in range(100)], "doc_id long, text string").repartition(4)
    same = [r for r in fingerprints.next_versions(hot).collect() if r["n_chars"] == len(PROSE)]
    assert len(same) == 60 and sum(r["near_next"] == 1.0 for r in same) == 59
    assert fingerprints.fingerprints(odd).count() == 10


def test_rows_that_share_an_id_are_cleaned_each_for_itself(spark):
    leak = "Which river flows through the old capital of the northern province? The answer is the long winding Omber river."
    docs = spark.createDataFrame([(1, leak), (1, "a clean text of its own"), (2, "another clean text"), (None, leak), (None, "clean too")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in decontaminate.clean(docs, bench).collect()) == [("1", "a clean text of its own"), ("2", "another clean text"), ("None", "clean too")]


def test_exceptions_are_swept(spark):
    model = toxicity.Model({" bad ": 3.0, " worse": 2.0}, [" bad day "], 1.0, -1.0).compile()
    text = toxicity.fold("bad day bad worse bad day " * 30)
    spans = model.evidence(text)[1]
    assert len(spans) == 60 and all(text[s:e].strip() in ("bad", "worse") for s, e, _ in spans)
    t = time.process_time()
    model.evidence(toxicity.fold("bad day bad " * 80_000))
    assert time.process_time() - t < 10
    held = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "doc_id long").select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] is not None for r in held)


COMMENTS = [
    "<section><h2>12 responses</h2><article class='comment'><p>Nice one, I liked this story a lot and want more of it.</p></article></section>",
    "<div id='comments'><h3>Comments</h3><p>Nice one, I liked this story a lot and want more of it.</p></div>",
    "<ol class='commentlist'><li class='comment even'><p>Nice one, I liked this story a lot and want more of it.</p></li></ol>",
    "<div class='post-comments'><p>Nice one, I liked this story a lot and want more of it.</p></div>",
    "<article class='reply'><p>Nice one, I liked this story a lot and want more of it.</p></article>",
    "<div><h2>Join in</h2><div class='comment-12'><p>Nice one, I liked this story a lot and want more of it.</p></div></div>",
    "<section class='responses'><p>Nice one, I liked this story a lot and want more of it.</p></section>",
    "<div id='disqus_thread'>Nice one, I liked this story a lot and want more of it.</div>",
    "<ins class='adsbygoogle'>Buy now</ins>", "<div class='ad-slot'>Buy now</div>", "<div class='google-ad'>Buy now</div>", "<div id='adbox'>Buy now</div>",
    "<form><label>Mail</label><input name=m></form>", "<label>Mail</label>", "<div class='sidebar'>Buy now</div>",
]


@pytest.mark.parametrize("tail", COMMENTS)
def test_what_is_not_the_article(tail):
    for page in (f"<html><body><main><article><p>{PROSE}</p></article>{tail}</main></body></html>", f"<body><div class='content'><p>{PROSE}</p><p>{PROSE}</p>{tail}</div></body>"):
        assert set(main_text(page).split("\n")) == {PROSE.strip()}


def test_last_words_of_an_article():
    page = f"<article><p>{PROSE}</p><div class='post-footer'><p>Closing words of the author, who thanks all of you.</p><a href=x>Share</a></div></article>"
    assert main_text(page).split("\n")[1:] == ["Closing words of the author, who thanks all of you."]


@pytest.mark.parametrize("shape", [lambda n: "<p><td>" + "<b>" * n + "<div></div>" * n, lambda n: "<tr><div>" + "<h1>" * n + "<tr></tr>" * n, lambda n: "<div class=comment>" * n + "<p>x</p>" * n])
def test_hostile_nesting_takes_linear_time(shape):
    t = time.process_time()
    main_text(shape(4000))
    once = time.process_time() - t
    t = time.process_time()
    main_text(shape(32_000))
    assert time.process_time() - t < 30 * max(once, 0.1)

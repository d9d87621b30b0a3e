import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lekhaspark.llm import decontaminate, html_text, prefix_tokens, quality, token_store, toxicity
from lekhaspark.llm.store import sieved, written

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))
WORD = re.compile(r"\w+")


def changed(text, spots):
    for m in sorted(spots, key=lambda m: -m.start()):
        text = text[: m.start()] + "qqq" + text[m.end() :]
    return text


def test_decontamination_finds_changed_and_cut_items(spark):
    """Every item with each single word changed, with two words changed, and cut off before its answer."""
    bench, rng, made = spark.read.parquet(f"{SF}/benchmark.parquet"), random.Random(8), []
    for r in bench.collect():
        spots = list(WORD.finditer(r["text"]))
        made += [(r["item_id"], changed(r["text"], [m])) for m in spots]
        made += [(r["item_id"], changed(r["text"], rng.sample(spots, 2))) for _ in range(20)]
        question, answer = decontaminate.question_and_answer(r["text"])
        if len(question) > 2 * len(answer):
            made.append((r["item_id"], r["text"][: spots[len(question) - 1].end()]))
    rows = [(k, i, f"zza zzb zzc zzd. {t} zze zzf {'zzg ' * 90}") for k, (i, t) in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, want long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench).collect()}
    assert {(k, i) for k, i, _ in rows} <= got
    assert decontaminate.clean(df, bench).count() == 0


def test_decontamination_leaves_other_answers(spark):
    """A question with another answer of the same words in another order and place is no item."""
    item = "What colour had the old lamp on the quay of Port Alder in winter? Green as bottle glass, said the keeper."
    other = "Said the keeper, glass as bottle green. A hundred boats went by. Nobody asked what colour any lamp had."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, item), (2, other)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find(df, bench).collect()] == [1]


CUTS = [
    "they're we'll I've it's 'r 're!''s counterrevolutionary", "“They’re” — naïve  ΟΔΟΣ　漢字漢字かな \U0001F600\u200d\U0001F600 <|endoftext|> it's", "x \n\t y  curly “quotes”\n\n after",
    "!!<|endoftext|><|startoftext|>é<|endof", "cafe\u0301 Vie\u0323\u0302t e\u0323\u0302\u0301 q\u0323\u0301x \u0301abc !!!\u0338\u0301!", "ภาษาไทยไม่มีช่องว่าง" * 3, "\u1112\u1161\u11ab\u1100\u116e\u11a8 한국",
    "İSTANBUL ſ ß ﬁ Ω K", "“'re” x’'ll “'ll'", "漢" * 150, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=" * 4, "\t\n a  b\x85c\xa0d\x1ce", "",
]


def test_token_counts_at_every_code_point(spark):
    """tokens_before and fit against the library at every cut."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    rng, letters = random.Random(2), "ab'rels “”ẹ\u0338\u0301<|>!1漢\u1112\u1161กิ่Σσİ \n\u3000"
    texts = CUTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) + rng.choice(["", "<|endoftext|>x"]) for _ in range(60)]
    want = {(k, i): len(lib.encode(t[:i], add_special_tokens=False).ids) for k, t in enumerate(texts) for i in range(len(t) + 1)}
    prefixes = prefix_tokens.token_prefixes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    cuts = prefixes.join(spark.createDataFrame(list(want), "doc_id long, cut int"), "doc_id")
    assert {(r["doc_id"], r["cut"]): r["n_before"] for r in prefix_tokens.tokens_before(cuts, F.col("cut")).collect()} == want
    for budget in (0, 1, 5, 40):
        longest = {k: max(i for i in range(len(t) + 1) if want[k, i] <= budget) for k, t in enumerate(texts)}
        assert {r["doc_id"]: r["fit_end"] for r in prefix_tokens.fit(prefixes, budget).collect()} == longest


def test_decontamination_retrieves_all_above_the_threshold(spark):
    """Against exhaustive BM25 scoring of every passage with every item, computed from words, not from lists."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: decontaminate._text_words(r["text"]).tolist() for r in bench.collect()}
    mean, df = sum(map(len, items.values())) / len(items), Counter(w for x in items.values() for w in set(x))
    impacts = {}
    for i, x in items.items():
        v = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, n in Counter(x).items()}
        impacts[i] = {w: y / sum(v.values()) for w, y in v.items()}
    texts = [decontaminate._text_words(r["text"] or "") for r in docs.collect()]
    texts += [np.concatenate((texts[k], np.array(x[: len(x) * 2 // 3], np.uint64), texts[k + 1])) for k, x in enumerate(items.values())]
    h, count = np.concatenate(texts), np.array([len(t) for t in texts])
    found = 0
    for index in next(decontaminate._indexes(bench)):
        want, at = {}, 0
        for r, t in enumerate(texts):
            for lo in range(0, len(t), index.segment):
                passage = set(t[lo : lo + 2 * index.segment].tolist())
                for i in index.ids:
                    score = sum(y for w, y in impacts[i].items() if w in passage)
                    if score >= decontaminate.THRESHOLD:
                        want[at + lo, r, i] = score
            at += len(t)
        got = {(lo, r, index.ids[k]): score for lo, r, k, score in index.above(h, count)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        found += len(got)
    assert found > len(items)


def test_decontamination_edges(spark):
    """Empty tables, clashing names, repeated rows and items, ties, a very long text with an item at its end."""
    item = "What is the capital of the old river kingdom of the north? The capital is the white town of Arvenhall by the sea."
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, item, 7), (1, item, 7), (2, f"{long} {item}", 7), (3, long, 7), (4, None, 7), (5, "", 7), (None, item, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, item, 1), (11, item, 1), (12, None, 1), (None, item, 1), (13, "", 1)], "item_id long, text string, doc_id int")
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.find(docs, bench).collect()) == [(d, i, 1.0) for d in (1, 2) for i in (10, 11)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.find(docs.limit(0), bench).count() == decontaminate.find(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == 7


def test_quality_estimates_accuracies(spark, monkeypatch):
    """Votes drawn with known accuracies of each rule: EM finds these and the hidden kind without labels. The pseudo-votes are light here, since
    the drawn rules are far worse than they say."""
    monkeypatch.setattr(quality, "PRIOR_WEIGHT", 0.01)
    rng, names = random.Random(3), [name for name, _, _ in quality.RULES]
    sharp = [0.55 + 0.4 * k / len(names) for k in range(len(names))]
    counts, kinds = Counter(), {}
    for _ in range(6000):
        good = rng.random() < 0.8
        votes = tuple(1 if rng.random() < 0.2 else 2 * (good == (rng.random() < a)) for a in sharp)
        counts[votes] += 1
        kinds.setdefault(votes, []).append(good)
    df = spark.createDataFrame([(*v, float(n)) for v, n in counts.items()], ", ".join(f"v_{n} int" for n in names) + ", n double")
    p, good, bad = quality.fit(df)
    assert abs(p - 0.8) < 0.05
    w = quality.PRIOR_WEIGHT
    for i, a in enumerate(sharp):  # the pseudo-votes pull by their stated weight
        assert abs(good[3 * i + 2] - (0.64 * a + w * quality.PRIOR["good"][2]) / (0.8 + w)) < 0.04
        assert abs(bad[3 * i] - (0.16 * a + w * quality.PRIOR["bad"][0]) / (0.2 + w)) < 0.09
    odds = {tuple(r[:-1]): r[-1] for r in df.select(*df.columns[:-1], quality._log_odds(p, good, bad)).collect()}
    # nearly as good as a judge who knows the true accuracies
    known = {v: np.log(4) + sum((x - 1) * np.log(a / (1 - a)) for x, a in zip(v, sharp)) for v in kinds}
    right = lambda by: sum((by[v] > 0) == k for v, ks in kinds.items() for k in ks)
    assert right(odds) > 0.995 * right(known) > 0.9 * 6000
    assert quality.accuracies(p, good, bad)[names[-1]][1] > quality.accuracies(p, good, bad)[names[0]][1]


def test_quality_votes_differ_and_verdicts_follow_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs).join(labels, "doc_id", "left").toPandas()
    past = got[~got.base_failed]
    votes = past[[c for c in got if c.startswith("v_")]]
    # every rule votes good on some documents and bad on some of all
    assert votes.shape[1] == len(quality.RULES) and all((got[c] == 2).any() for c in votes)
    assert sum((got[c] == 0).any() for c in votes) >= 9
    # past the base a document may have bad votes and stay, or go with them: the posterior decides, not any one rule
    assert ((votes == 0).any(axis=1) & past.kept).sum() >= 20 and (~past.kept).sum() >= 20
    known = got[~got.base_failed & got.quality.notna()]
    assert (known.kept == (known.quality == 1)).mean() > 0.99
    stage = corpus_pipeline.quality_rules(spark, docs, SF).join(labels, "doc_id").toPandas()
    assert (stage.quality == 1).sum() >= 0.97 * (got.quality == 1).sum() and (stage.quality == 0).sum() <= 0.05 * (got.quality == 0).sum()


def test_toxicity_on_rows_never_learned_from(spark):
    """Labels of the table itself: the held-out fold is scored by a model that never saw it; its clean rows stay clean."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(toxicity.labelled(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))
    known = docs.join(labels.where(toxicity.held_out(F.col("doc_id"))), "doc_id")
    got = toxicity.score(known, model).join(labels, "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    rank = got.score.rank()
    auc = (rank[got.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert len(toxic) > 30 and auc > 0.95 and toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01


def test_toxicity_edges(spark):
    """No labels of one kind, empty tables, nulls, very long texts, repeated rows and clashing names."""
    rows = [(1, "you utter moron", "x"), (1, "you utter moron", "x"), (2, None, "x"), (3, "", "x"), (None, "fine words " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.learn(toxicity.labelled(docs, labels))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and not r["matches"] for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(toxicity.labelled(docs, labels.limit(0))).lexicon == {}


def test_store_finds_exchanged_chunks(spark, tmp_path):
    """Two chunks of one recipe change places: every chunk still holds what its name says, but the recipe's hash does not."""
    text = " ".join(f"word{k % 997}x{k}" for k in range(6000))
    path = token_store.write_store(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), PATH, str(tmp_path / "store"))
    assert token_store.read_back(spark, path).count() == 2
    recipes = spark.read.parquet(f"{path}/recipes")
    assert recipes.where("size(chunks) > 2").count() == 1
    changed = recipes.withColumn("chunks", F.reverse("chunks")).collect()
    spark.createDataFrame(changed, recipes.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    assert not token_store.verify_manifest(spark, path)
    with pytest.raises(ValueError):
        token_store.read_back(spark, path)


def test_stages_one_after_another_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names, empty tables: every stage takes what
    the one before it left and returns the columns of documents."""
    prose = " ".join(f"{w}." if k % 9 == 8 else w for k, w in enumerate(("the river of the town is to be seen from the hill and it runs by the mill in a long slow bend " * 6).split()))
    # words of letters, and no three of them twice
    named = lambda x, k: x + "".join("abcdefghij"[int(c)] for c in str(k))
    plain = lambda x: " ".join(f"The {named(x, k)} of {named('vale', k)} and {named('moor', k)} is {named('well', k)} to be {named('seen', k)} in {named('yard', k)}." for k in range(60))
    long = " ".join(f"The w{k} of v{k % 977} is in the x{k % 31} and it is to be." for k in range(12_000))
    rows = [(1, plain("mill"), "en", "s", 1), (1, plain("mill"), "en", "s", 1), (2, plain("mill"), None, None, None), (None, plain("mill"), "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0),
            (None, None, None, None, None), (5, " \n\t ", "en", "s", 3), (6, long, "en", "t", 9), (7, "one", "en", "s", 3), (8, plain("inn"), "en", None, 5), (9, prose, "en", "u", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = df.withColumns({c: F.lit("x") for c in ("size", "key", "range", "digest", "cid", "node", "words", "lines", "kept", "_row", "_key", "_gone", "bucket", "score", "taken")})
    for docs in (extra, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            if name.startswith("mixing") and not docs.isEmpty():
                # the good rows have come so far; the mix takes of them what its targets leave room for
                assert {1, 8} <= {r["doc_id"] for r in docs.collect()} <= {1, 6, 7, 8}
            after = written(stage(spark, docs, SF), "stage")
            assert after.columns == df.columns or after.columns == extra.columns, name
            docs = after
        ids = {r["doc_id"] for r in docs.collect()}
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()
        assert ids <= {1, 6, 7, 8}
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_token_counts_of_empty_and_clashing_tables(spark):
    rows = spark.createDataFrame([(1, "two words", 5, "x"), (None, None, 6, "y")], "doc_id long, text string, n_tokens int, piece string")
    got = prefix_tokens.token_prefixes(rows, PATH)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got.collect()) == [(0, 0, 0), (1, 9, 2)]
    assert prefix_tokens.token_prefixes(rows.limit(0), PATH).count() == 0


def test_sieve_loses_no_row(spark):
    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    keys = rows.where("a % 11 = 0")
    left = sieved(rows, keys, "a", "b")
    assert left.columns == ["a", "b"] and left.where("a % 11 = 0").count() == keys.count() and left.count() < keys.count() + 20
    assert sieved(rows, keys.limit(0), "a").count() == 0


PROSE = [f"Paragraph {k} of the article, which goes on for a while, with commas and a full stop." for k in range(4)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
BESIDE = "<nav><a href=x>menu of the page</a></nav><div class=sidebar><p>Side note, which is no part of the article.</p></div>"
TALK = "<div class=comments>" + "".join(f"<div class=comment-body><p>Comment {k}, which I wrote, as ever, at great length, to say no.</p></div>" for k in range(30)) + "</div>"


@pytest.mark.parametrize("page", [
    *(f'<body><div class="{name}">{BESIDE}{BODY}{TALK}</div><div class=footer>and so on, and so on, and so on</div></body>' for name in ("content no-sidebar", "page has-sidebar", "post hentry tag-news", "side-by-side")),
    f'<body><form action="x.aspx"><div class="page has-sidebar">{BESIDE}<div>{BODY}</div></div><div>{TALK}</div></form></body>',
    f'<body><svg class=icon viewBox="0 0 1 1"/><div>{BODY}</div></body>',
    f'<body><iframe src="x"/><div>{BODY}</div><svg><text>no</text></svg></body>',
    f'<body><div class=content>{BODY}</div><div class=comments><p>{"One single comment, longer than the article itself. " * 20}</p></div>{BESIDE}</body>',
    f"<body><form>{TALK}<p>Leave, if you like, a reply to what was said here.</p></form><div>{BODY}</div></body>",
])
def test_html_keeps_wrapped_articles(page):
    assert html_text.main_text(page) == "\n".join(PROSE)


@pytest.mark.parametrize("page, text", [
    (f"<article><h2 class=legal>Law</h2>{BODY.replace('<p>', '<p class=notice>')}</article>", ["Law", *PROSE]),
    (f"<body><header>Site</header><article><header><h1>Title</h1></header>{BODY}<footer>shared</footer></article></body>", ["Title", *PROSE]),
    (f'<body><p title="x>Hello world.</p>{BODY}', ["Hello world.", *PROSE]),
    (f"<body><nav>menu</nav><div id=a>{BODY}</div><div id=b>{BODY}</div><div>A closing remark.</div></body>", [*PROSE, *PROSE, "A closing remark."]),
    (f"<body><div id=a>{BODY}</div><div><a href=x>one link</a> <a href=y>and another link</a></div></body>", PROSE),
    (f"<script>if (a<b) x='<div class=\"y'</script><div>{BODY}</div><!-- no end", PROSE),
    ("<p>5 < 6 &amp; 7 &gt; 6, a <b>bold</b>ly put\n claim<br>in two lines", ["5 < 6 & 7 > 6, a boldly put claim in two lines"]),
])
def test_html_shapes(page, text):
    assert html_text.main_text(page) == "\n".join(text)


@pytest.mark.parametrize("page", [
    "<a \"" * 260_000, "<a x=\"" * 170_000, "<a x='>" * 150_000, "<div>" * 100_000 + "<p>one, two</p>" * 30_000, "<b>" * 100_000 + "<h2>x</h2>" * 50_000,
    "<div class=ad>" * 30_000 + "<p>A sentence of more than five and twenty letters.</p>" * 10_000, "<p></span>" * 100_000, "<!--" * 250_000, "</ " * 300_000, "<" * 1_000_000, "&amp" * 250_000,
])
def test_html_time_grows_with_the_page(page):
    """Hostile pages of about 1 MB."""
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 4


def test_html_finds_made_articles(spark):
    """Pages made around known articles, in every wrapper: the text is the article's blocks and nothing else; empty tables and clashing names."""
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(120):
        blocks = [" ".join(rng.choice(["word", "naïve", "漢字", "a &lt; b"]) for _ in range(rng.randrange(6, 60))) + "." for _ in range(rng.randrange(2, 9))]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>"]).format(x) for x in blocks)
        shell = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>", "<form><div class='page no-sidebar'>{}</div></form>", "<section id=x>{}</section>"])
        rows.append((k, "u", f"<html><head><title>t</title></head><body>{BESIDE}<div class=cookie-consent>We use cookies, as ever.</div>{shell.format(body)}<footer>end</footer>{TALK * (k % 2)}", "x"))
        want[k] = "\n".join(x.replace("&lt;", "<") for x in blocks)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(want[r["page_id"]]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def test_pipeline_rows_without_or_with_shared_ids(spark):
    """Only the rejected rows go, and a copy without a doc_id leaves before the one that has it."""
    good, other = (" ".join(f"{x}river{k}" + "." * (k % 12 == 11) for k in range(240)) for x in "ab")
    junk = "# $ % & " * 40
    rows = [(1, good), (None, other), (None, junk), (None, good), (2, junk), (2, other + " And so it was."), (3, junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = quality.keep_good(df)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if r[1] != junk), key=repr)
    once = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert sorted(map(tuple, once.collect()), key=repr) == [(1, good), (2, other + " And so it was.")]

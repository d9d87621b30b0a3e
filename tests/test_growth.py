"""What a step costs for each row: texts are read once, pages meet their answers in one join, blocks of vectors are small."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lekhaspark.functions import legacy_font, references
from lekhaspark.functions import transliteration as T
from lekhaspark.operators import answers, contexts, duplicates, matching, mining, search, suggest, tables, vectors
from lekhaspark.sources import cms


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_answers_meet_their_pages_once(spark):
    texts = spark.createDataFrame([(1, "The limit is 5 [S1 p.1].\nIt is 7."), (2, None)], "k long, text string")
    pages = spark.createDataFrame([(1, "S1", 1, ["limit 6"], False)], "k long, label string, page int, texts array<string>, risky boolean")
    found = answers.numeric_issues(answers.claim_units(texts, "k", "text"), "k", pages)
    assert sorted(map(tuple, found.collect())) == [(1, 0, "unsupported"), (1, 1, "uncited")]
    assert plan(found).count("Join ") == 1


def test_pages_are_read_once(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a</td></tr></table>")], "page_id long, html string")
    assert plan(tables.portal_rows(pages)).count("ArrowEvalPython") == 1


def test_words_are_respelt_once(spark):
    words = spark.createDataFrame([("नियम", 2), ("संख्या", 1)], "word string, weight long")
    known = suggest.lexicon(words)
    assert plan(known).count("Expand") == 3
    assert {r["word"]: (r["loose"], r["loose_bare"]) for r in known.collect()} == {"नियम": ("niyam", "niyam"), "संख्या": ("sankhya", "sakhya")}
    assert [len(g) for g, _ in T._merged([("b", "ब"), ("c", "च"), ("च", "x"), ("[d]", "द")])] == [2, 1, 1]
    legacy_font._typed_word.cache_clear()
    legacy_font.encode("नियम नियम")
    assert legacy_font._typed_word.cache_info().hits == 1


def test_blocks_of_vectors_are_small(spark):
    rows = [(k, [float(k % 7) + 1, float(k % 5), 1.0]) for k in range(3 * vectors.STEP)]
    d = spark.createDataFrame(rows, "i long, v array<float>").coalesce(1)
    got = [(r["i"], r["rank"]) for r in vectors.nearest(d, d.where("i = 3"), "i", "v", 5).orderBy("rank").collect()]
    m = vectors._matrix(pa.array([v for _, v in rows], pa.list_(pa.float32())))
    s = np.round(m @ m[3], vectors.DIGITS)
    assert got == [(int(k), n + 1) for n, k in enumerate(np.lexsort((np.arange(len(s)), -s))[:5])]
    assert vectors.BLOCK * vectors.STEP * 8 <= 1 << 22


def test_texts_of_references_are_made_once(spark):
    docs = spark.createDataFrame([(1, "No. 5/2001 dated 3.2.01 is cancelled."), (2, "No.‌ ५/2001  dated\t3 Feb, 2001 supersed"), (3, "no date"), (4, None)], "id long, t string")
    found = references.order_references(docs.select("id", F.concat("t", F.lit(" made")).alias("t")), "id", "t", evidence=False)
    assert sorted((r["id"], r["go_key"], str(r["go_date"]), r["kind"]) for r in found.collect()) == [(1, "5/2001", "2001-02-03", "cancels"), (2, "5/2001", "2001-02-03", "supersedes")]
    assert "evidence" not in found.columns and plan(found).count(" made") == 1


def test_links_of_an_index_are_read_once(spark):
    page = """<a href="1.html">A &amp; B</a><a href='1.html'>2-3</a><a href=2.html#x>Caf&#233; &lt;</a><a href="">x</a><a href="'3.html">q</a>"""
    found = contexts.handbook_links(spark.createDataFrame([(1, "https://x.in/b/i.html", page)], "volume int, url string, html string"))
    assert [(r["place"], r["url"], r["label"]) for r in found.orderBy("place").collect()] == [(0, "https://x.in/b/1.html", "A & B"), (1, "https://x.in/b/1.html", "2-3"), (2, "https://x.in/b/2.html", "Café <"), (4, "https://x.in/b/'3.html", "q")]
    assert plan(found).count("&amp;,") <= 2


def test_texts_of_overlaps_are_read_a_few_times(spark):
    words = lambda k: F.array_distinct(F.split(k, " ")).alias("words")
    left = spark.createDataFrame([(1, "x y z u v"), (2, "p"), (3, None)], "a int, t string").select("a", words("t"))
    right = spark.createDataFrame([(1, "x y z u w"), (2, "x y"), (3, "q p x y r s"), (4, "k l"), (5, None)], "b int, t string").select("b", words("t"))
    found = duplicates.overlap_pairs(left, right, 0.8)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0.8), (1, 2, 1.0), (2, 3, 1.0)]
    assert plan(found).count("split(") <= 10


def test_texts_are_dealt_by_page_before_they_are_words(spark):
    pages = spark.createDataFrame([(1, "red fox red"), (2, "red hen"), (3, "cat"), (4, "dog"), (5, "owl"), (6, "elk"), (7, "ant"), (None, "fox")], "page int, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "hen")], "query int, question string")
    found = mining.keyword_candidates(asked, pages, 5)
    assert [(r["query"], r["page"], r["place"]) for r in found.orderBy("query", "place").collect()] == [(1, 1, 1), (1, 2, 2)]
    assert "RepartitionByExpression [page" in plan(found)


def test_posts_of_a_site_need_no_order(spark):
    listing = '{"posts": [{"ID": 7, "post_title": "A", "acf_data": {"file": [{"file": [1, 2]}]}}, {"ID": 8, "post_title": "B", "acf_data": {"file": []}}]}'
    answers = spark.createDataFrame([(1, "s", listing), (2, "s", listing.replace("7", "9")), (3, "s", "no")], "place int, site string, body string")
    files = spark.createDataFrame([("s", k, f'{{"posts": {{"acf_data": {{"pdf": {{"url": "u{k}"}}}}}}}}') for k in (1, 2)], "site string, file_id long, body string")
    found = cms.cms_posts(answers, files)
    assert [(r["post_id"], [f["url"] for f in r["files"]]) for r in found.orderBy("place").collect()] == [(7, ["u1", "u2"]), (8, []), (9, ["u1", "u2"]), (8, [])]
    assert "Window" not in plan(found)


def test_sorted_rows_are_dealt_to_a_stated_number_of_tasks(spark):
    numbers = spark.createDataFrame([("a", 5, 7), ("a", 1, 3), ("a", 2, 2), ("a", 8, 8), ("a", 10, 10), ("a", 9, 4), ("b", 1, 9), ("b", 2, 3), ("b", 10, 12)], "k string, first int, last int")
    found = contexts.compressed_ranges(numbers, "k")
    assert {r["k"]: r["ranges"] for r in found.collect()} == {"a": "1-3, 5-8, 10", "b": "1-12"}
    assert "RepartitionByExpression [k" in plan(found) and plan(found).count("Aggregate") == 1


def test_words_of_a_text_stay_in_its_task(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "fox"), (2, "fox"), (3, None), (4, "cat")], "d int, t string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "owl")], "q int, a string")
    found = search.keyword_hits(docs, "d", "t", asked, "q", "a", [])
    assert [(r["q"], r["d"], r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 2, 1), (1, 1, 2)]
    assert "RepartitionByExpression [d" in plan(found) and "LeftSemi" not in plan(found)


def test_phrases_start_python_once_a_table(spark):
    asked = spark.createDataFrame([(1, "Rate of Subsidy, rate"), (2, ""), (3, None)], "query int, question string")
    phrases = spark.createDataFrame([(1, "subsidy"), (2, "rate of subsidy"), (3, "-"), (4, None)], "entry int, phrase string")
    found = matching.phrase_hits(asked, phrases)
    assert sorted((r["query"], r["entry"], r["n_words"]) for r in found.collect()) == [(1, 1, 1), (1, 2, 3)]
    assert plan(found).count("ArrowEvalPython") == 2

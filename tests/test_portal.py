from pyspark.sql import functions as F

from lekhaspark.operators import listings, matching, mining


def test_spellings_and_official_terms(spark):
    registry = spark.createDataFrame([(1, "कृषि विभाग"), (1, "Agriculture"), (2, "Home")], "entry int, phrase string")
    names = spark.createDataFrame([("agriculture department",), ("कृषि",), ("Zoo",)], "name string")
    got = {(r[0], r[1]) for r in matching.spellings(names, registry).collect()}
    assert ("agriculture department", "कृषि विभाग") in got and ("कृषि", "Agriculture") in got and [s for n, s in got if n == "Zoo"] == ["Zoo"]
    terms = spark.createDataFrame([(1, ["pension"], ["पेंशन"], []), (2, ["purchase"], ["क्रय"], ["खरीद"])], "place int, english array<string>, official array<string>, everyday array<string>")
    asked = spark.createDataFrame([(1, "Pension rules"), (2, "खरीद के नियम"), (3, "क्रय and purchase"), (4, "pensioner")], "query int, question string")
    assert {r["query"]: r["terms"] for r in matching.official_terms(asked, terms).collect() if r["terms"]} == {1: ["पेंशन"], 2: ["purchase", "क्रय"]}


def test_pagers(spark):
    html = "<p>Displaying 11 - 20 of 45</p><a href=\"javascript:__doPostBack(&#39;grid&#39;,&#39;Page$2&#39;)\">2</a> __doPostBack('grid','Page$2') __doPostBack('grid','Page$Next')"
    df = spark.createDataFrame([(html,)], "h string")
    r = df.select(listings.postbacks(F.col("h")).alias("p"), listings.totals(F.col("h")).alias("t"), listings.totals(F.lit("none")).alias("n")).first()
    assert [tuple(x) for x in r["p"]] == [("grid", "Page$2"), ("grid", "Page$Next")] and tuple(r["t"]) == (45, 10) and r["n"] is None
    base = "https://a.gov/orders"
    urls = [f"{base}?page=2", f"{base}/page/3/", base, "https://b.gov/orders?page=2", "https://a.gov/other?page=2", f"{base}?q=1"]
    links = spark.createDataFrame([(1, base, u) for u in urls], "page_id int, page_url string, url string")
    assert {r["url"] for r in listings.pager_links(links).collect()} == {f"{base}?page=2"}
    own = links.withColumn("page_url", F.lit(base + "/"))
    assert {r["url"] for r in listings.pager_links(own).collect()} == {f"{base}/page/3/"}


def test_hosts_and_reports(spark):
    sites = spark.createDataFrame([("s", ["http://www.a.gov/x", "https://b.gov/"])], "id string, listing_urls array<string>")
    assert {(r["host"], r["plain"]) for r in listings.site_hosts(sites).collect()} == {("www.a.gov", True), ("a.gov", True), ("b.gov", False), ("www.b.gov", False)}
    table = listings.markdown_table(spark.createDataFrame([(2, "a|b"), (1, None)], "n int, x string"), ["n"])
    assert table == "| n | x |\n|---|---|\n| 1 |  |\n| 2 | a\\|b |\n"


def test_batches_after_a_changed_page_size(spark):
    rows = [("l", 1, 1, 10, ["a", "b"]), ("l", 2, 1, 10, ["a", "b"]), ("l", 3, 1, 10, ["a", "c"]), ("l", 4, 1, 20, ["a", "c"]), ("l", 5, 2, 20, ["d", "d"])]
    df = spark.createDataFrame(rows, "listing string, seq int, page int, page_size int, ids array<string>")
    assert [(r["kind"], r["added"]) for r in listings.page_batches(df).orderBy("seq").collect()] == [("saved", 2), ("repeated", 0), ("reshuffled", 1), ("saved", 0), ("saved", 1)]


def test_parts(spark):
    one = lambda t, n: spark.createDataFrame([(t,)], "x string").select(listings.split_text(F.col("x"), n)).first()[0]
    assert one("aa\nbb\ncc", 5) == ["aa\nbb", "cc"] and one("abcdefg", 3) == ["abc", "def", "g"] and one("", 5) == [""]
    rows = [(1, ["p", "q"], "=== PAGE 1 ===\none\n=== PAGE 2 ===\ntwo\n"), (2, ["p", "q"], "=== PAGE 2 ===\nx\n=== PAGE 1 ===\ny"), (3, ["p"], "Sure:\n=== PAGE 1 ===\nx"), (4, ["p", "q"], "=== PAGE 1 ===\nx")]
    got = mining.ocr_parts(spark.createDataFrame(rows, "batch int, pages array<string>, text string")).collect()
    assert {(r["batch"], r["page"], r["text"]) for r in got} == {(1, "p", "one"), (1, "q", "two")}


def test_comparisons(spark):
    a, b = (spark.createDataFrame([(k, 1.0, r) for k, r in enumerate(x)], "query int, positive_score double, rank int") for x in ((1, 2, 11), (1, 1, 4)))
    r = mining.accept_if_better(a, b).first()
    assert (r["before"], r["after"], r["accepted"]) == (0.5, 0.75, True)
    runs = spark.createDataFrame([("m", 1, True), ("n", 1, False), ("m", 2, True)], "model string, case_id int, passed boolean")
    assert [tuple(r) for r in mining.side_by_side(runs, ["m", "n"]).orderBy("case_id").collect()] == [(1, True, False), (2, True, None)]
    assert mining.tfidf(spark.createDataFrame([], "page int, text string")).count() == 0

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lekhaspark.operators import amendments as A
from lekhaspark.operators import audits
from lekhaspark.operators import contexts as C
from lekhaspark.operators import procurement, profiles

VITTA = "core-rules-leave-rules"


@pytest.fixture(scope="module")
def register(spark):
    entries = [("sr153", 1, "SR 153: maternity leave"), ("x", 2, "Rule X"), ("book", 3, "Rule in a book")]
    pages = [("sr153", "rule", 1, "vol2", 183), ("sr153", "rule", 2, "vol2", 184), ("sr153", "current", 1, VITTA, 9), ("sr153", "current", 2, VITTA, 10), ("x", "rule", 1, "book", 5), ("x", "order", 1, "7#1#2#2024", 1), ("book", "rule", 1, "vol2", 300), ("book", "order", 1, "vol2", 310)]
    triggers, contexts = [("sr153", "maternity leave"), ("sr153", "प्रसूति अवकाश"), ("x", "limit")], [("x", "earned leave")]
    make = spark.createDataFrame
    return make(entries, "entry string, place int, rule string"), make(pages, "entry string, kind string, at int, source_id string, page_number int"), make(triggers, "entry string, phrase string"), make(contexts, "entry string, phrase string")


@pytest.fixture(scope="module")
def evidence(spark):
    rows = [(1, 1, "a", 1), (1, 2, "vol2", 183), (2, 1, "7#1#2#2024", 3), (3, 1, "vol2", 1), (4, 1, "z", 1), (5, 1, "z", 1), (6, 1, "vol2", 310)]
    return spark.createDataFrame(rows, "query int, place int, source_id string, page_number int")


def test_register(spark, register, evidence):
    entries, pages, triggers, contexts = register
    asked = spark.createDataFrame([(4, "महिला कर्मचारी को प्रसूति अवकाश कितने दिन"), (5, "the limit of it"), (3, "limit of earned leave"), (1, None)], "query int, question string")
    found = A.matched(evidence, pages, asked, triggers, contexts)
    assert sorted((r["query"], r["entry"]) for r in found.collect()) == [(1, "sr153"), (2, "x"), (3, "x"), (4, "sr153"), (6, "book")]
    missing = A.missing_pages(found, entries, pages, evidence)
    got = {}
    for r in missing.orderBy("query", "n").collect():
        got.setdefault(r["query"], []).append((r["source_id"], r["page_number"]))
    assert got == {1: [("vol2", 184), (VITTA, 9), (VITTA, 10)], 2: [("book", 5), ("7#1#2#2024", 1)], 3: [("book", 5), ("7#1#2#2024", 1)], 4: [("vol2", 183), ("vol2", 184), (VITTA, 9), (VITTA, 10)], 6: [("vol2", 300)]}
    assert A.missing_pages(found, entries, pages, evidence, 2).where("query = 4").count() == 2
    archive = spark.createDataFrame([(VITTA, 9), ("book", 5)], "source_id string, page_number int")
    labels = [(r["query"], r["label"], r["source_id"], r["added"]) for r in A.append_evidence(evidence, missing, archive).orderBy("query", F.length("label"), "label").collect()]
    assert labels[:3] == [(1, "S1", "a", False), (1, "S2", "vol2", False), (1, "S3", VITTA, True)] and (2, "S2", "book", True) in labels and len(labels) == 11


def test_cards(spark, register):
    entries, pages, _, _ = register
    orders = spark.createDataFrame([("sr153", 1, "G-4-484/X-90-216-79", datetime.date(1990, 5, 3)), ("x", 1, "12/2024", None), ("book", 1, "9/2020", None)], "entry string, at int, go_number string, go_date date")
    notes = {(r["source_id"], r["direction"], r["go_number"], r["go_source_id"]) for r in A.card_notes(entries, pages, orders).collect()}
    assert notes == {("vol2", "amended_by", "G-4-484/X-90-216-79", None), ("book", "amended_by", "12/2024", "7#1#2#2024"), ("7#1#2#2024", "amends", "12/2024", "7#1#2#2024"), ("vol2", "amended_by", "9/2020", "vol2")}
    line = orders.select(A.note_line(F.col("go_number"), F.col("go_date"), F.lit("period raised"), F.lit(None).cast("string")).alias("x")).first()["x"]
    assert line == "Amended by GO G-4-484/X-90-216-79 dated 03.05.1990 — period raised (GO not in the archive; name it, do not cite it)"


BLOCK = "query int, place int, label string, source_id string, page_number int, role string, anchor_page int, jurisdiction_code string, provider string, tier string, department string, go_number string, go_date string, variant string, canonical boolean, conflict boolean, verification string, status string, selected_text string, canonical_text string, later_changes string"


def test_context(spark):
    page = (1, "S1", "1#2#3#2020", 4, "direct", None, "UP", "portal", "A", None, "5/2020", "2020-01-02", "native", True, False, "native_primary", "superseded", "rule 12 " * 400, "other text", "6/2021 amends it")
    risky = (2, "S2", "9#2#3#2020", 7, "neighbor", 4, "IN", "core-rules", None, "Finance", "7/2020", None, "ocr", False, True, "conflict", "current", "pay 500 rupees " * 200, "pay 600", None)
    df = spark.createDataFrame([(1, *page), (1, *risky), (2, *risky)], BLOCK)
    got = {r["query"]: r for r in C.evidence_context(df, ["core-rules"]).collect()}
    first, second = got[1]["context"].split(C.BETWEEN)
    assert first.startswith("SOURCE S1\nSOURCE_ID=1#2#3#2020\nPAGE=4\nRETRIEVAL_ROLE=direct\nANCHOR_PAGE=none\nJURISDICTION=Uttar Pradesh (state)\nAUTHORITY=GENERAL\nDEPARTMENT=unknown\nGO_NUMBER=5/2020\nGO_DATE=2020-01-02\n")
    assert "STATUS=SUPERSEDED\nLATER_CHANGES=6/2021 amends it\n\nSELECTED PAGE TEXT:\nrule 12 " in first and first.endswith(C.CLIPPED + "\n\nCANONICAL PAGE TEXT:\nother text")
    assert "SOURCE_ID=" + C.WITHHELD in second and "500" not in second and "600" not in second and "7/2020" not in second and "AUTHORITY=RULEBOOK" in second and "STATUS=CURRENT" not in second
    assert len(second.split("SELECTED PAGE TEXT:\n")[1]) == C.NEIGHBOUR + len(C.CLIPPED)
    for budget in (0, 1000, 2000, 3600, 10_000):
        for r in C.evidence_context(df, ["core-rules"], budget).collect():
            assert r["n_chars"] == len(r["context"]) <= budget
    assert {r["query"]: r["blocks"] for r in C.evidence_context(df, ["core-rules"], 2000).collect()} == {1: 1, 2: 1}
    asked = spark.createDataFrame([(1,), (9,)], "query int")
    assert [r["context"] for r in C.no_evidence(asked, C.evidence_context(df, [])).where("query = 9").collect()] == ["NO EVIDENCE WAS RETRIEVED."]


def test_handbook_index(spark):
    html = """<a href="../index.html">Home</a><a href='01.html'>CHAPTER I&mdash;General Scope</a><a href=01.html>1—4–A</a><a href="03.HTM#x">003</a><a href="02.html"><b>CHAPTER II</b></a><a href="06.doc">006</a>
    <a href="https://x.up.nic.in/other/1.html">x</a><a href="mailto:a@b">m</a><a href="index.html">self</a><a href="02.html">CHAPTER II</a><a href="02.html">5-9</a><a href="02.html">11—12</a><a href="/book/CSR/04.html">348–A—357–C</a>"""
    df = spark.createDataFrame([("csr", "https://x.up.nic.in/book/CSR/index.html", html), ("none", "https://x/y/", None)], "volume string, url string, html string")
    base = "https://x.up.nic.in/book/CSR/"
    assert [(r["n"], r["url"], r["label"]) for r in C.handbook_index(df).orderBy("n").collect()] == [
        (1, base + "01.html", "CHAPTER I–General Scope (paras 1—4–A)"), (2, base + "03.HTM", ""), (3, base + "02.html", "CHAPTER II (paras 5-9, 11—12)"), (4, base + "04.html", "Paras 348–A—357–C")]
    assert [r["url"] for r in C.handbook_links(df).where("not page").collect()] == [base + "06.doc"]
    numbers = spark.createDataFrame([("a", 5, 9), ("a", 1, 2), ("a", 3, 3), ("a", 7, 8), ("a", 12, 12), ("b", 4, 4), ("b", 9, 2)], "k string, first int, last int")
    assert {r["k"]: r["ranges"] for r in C.compressed_ranges(numbers, "k").collect()} == {"a": "1-3, 5-9, 12", "b": "4"}


def brute_profiles(profiles, requests):
    out, log = dict(profiles), []
    for at, number, user, action in sorted(requests):
        active = sum(v is None for v in out.values())
        if user not in out or out[user] is not None and out[user] + datetime.timedelta(days=7) <= at:
            o = "unknown"
        elif (action == "restore") == (out[user] is None):
            o = "again"
        elif action == "restore":
            o = "full" if active >= 5 else "done"
        else:
            o = "last" if active <= 1 else "done"
        if o == "done":
            out[user] = None if action == "restore" else at
        log.append((number, o))
    return out, log


def test_profiles(spark):
    rng = random.Random(2)
    day = datetime.datetime(2026, 1, 1)
    own, asked, want = [], [], {}
    for account in range(60):
        users = {u: rng.choice([None, None, None, day]) for u in range(rng.randint(0, 9))}
        log = [(day + datetime.timedelta(hours=rng.randint(0, 300)), k, rng.randint(0, 9), rng.choice(["delete", "delete", "restore"])) for k in range(rng.randint(0, 12))]
        own += [(account, u, v) for u, v in users.items()]
        asked += [(account, k, at, u, a) for at, k, u, a in log]
        if users or log:
            want[account] = brute_profiles(users, log)
    got = profiles.after_requests(spark.createDataFrame(own, "account int, user_id int, deleted_at timestamp"), spark.createDataFrame(asked, "account int, number int, at timestamp, user_id int, action string"))
    rows = {r["account"]: r for r in got.collect()}
    assert rows.keys() == want.keys()
    for account, (users, log) in want.items():
        assert {p["user_id"]: p["deleted_at"] for p in rows[account]["profiles"]} == users and [tuple(o) for o in rows[account]["outcomes"]] == log
    assert {o for _, log in want.values() for _, o in log} == {"done", "again", "last", "full", "unknown"}
    late = profiles.purged(got, F.lit(day + datetime.timedelta(days=60))).collect()
    assert all(p["deleted_at"] is None for r in late for p in r["profiles"])


def test_named_books(spark):
    cases = {
        "UP GeM orders on EMD": (["UP GeM orders"], True), "जेम पोर्टल के शासनादेश": (["UP GeM orders"], True), "payment terms guideline in GFR and the Manual of Procurement of Goods": (["GFR 2017", "Manual for Procurement of Goods"], True),
        "UP Procurement Manual 2016 for goods": (["UP Procurement Manual (Goods) 2016"], True), "non-consultancy manual": (["Manual for Procurement of Non-Consultancy Services"], False), "leave rules": ([], False), "": ([], False), None: (None, None),
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", procurement.named_books(F.col("q")).alias("b"), procurement.is_buying(F.col("q")).alias("p")).collect()
    assert {r["q"]: (r["b"], r["p"]) for r in rows if r["q"] is not None} == {q: v for q, v in cases.items() if q is not None}
    e = "query int, place int, source_id string, page_number int"
    evidence = spark.createDataFrame([(1, 1, "x", 1), (1, 2, "gfr", 5), (1, 3, "x", 2), (1, 4, "go", 1), (1, 5, "gfr", 4)], e)
    ranks = spark.createDataFrame([("go", 1), ("gfr", 3)], "source_id string, rank int")
    order = [(r["source_id"], r["page_number"]) for r in procurement.by_authority(evidence, ranks).orderBy("label").collect()]
    assert order == [("go", 1), ("gfr", 5), ("gfr", 4), ("x", 1), ("x", 2)]
    extra = spark.createDataFrame([(1, 1, "gfr", 4), (1, 2, "gtc", 9)], e)
    assert [(r["source_id"], r["page_number"]) for r in procurement.named_first(evidence, extra, 3).orderBy("label").collect()] == [("gfr", 4), ("gtc", 9), ("x", 1)]
    assert procurement.named_first(evidence, extra, 1).count() == 2
    books = spark.createDataFrame([("GFR", "gfr"), ("GTC", "gtc")], "book string, source_id string")
    named = spark.createDataFrame([(1, "GFR"), (1, "GTC")], "query int, book string")
    assert [r["book"] for r in procurement.missing_books(named, books, evidence).collect()] == ["GTC"]


def test_audits(spark):
    v = [("a", 1, 1, "native", True, "Rule 5 of 2020, 1,000"), ("a", 1, 2, "ocr", False, "Rule ५ of 2020; 7,000."), ("a", 2, 3, "native", True, "5"), ("a", 2, 4, "ocr", True, "6"), ("a", 3, 5, "native", True, None), ("a", 3, 6, "ocr", False, "no number")]
    got = audits.numeric_conflicts(spark.createDataFrame(v, "source_id string, page_number int, variant_id int, variant_type string, canonical boolean, text string")).orderBy("page_number").collect()
    assert [tuple(r) for r in got] == [("a", 1, ["1,000"], ["7,000"], True), ("a", 3, [], [], False)]
    lengths = [("x", f"d{k % 3}", k, n) for k, n in enumerate([5, 100, 119, 120, 1900, 1901, 7, 7, 7, 3000])]
    r = audits.length_report(spark.createDataFrame(lengths, "s string, source_id string, page_number int, length int"), "s").first()
    values = sorted(n for *_, n in lengths)
    assert [r[c] for c in ("p25", "p50", "p75", "p95")] == [values[math.floor(9 * p)] for p in (0.25, 0.5, 0.75, 0.95)]
    assert (r["chunks"], r["documents"], r["pages"], r["shortest"], r["longest"], r["short"], r["long"]) == (10, 3, 10, 5, 3000, 6, 2)
    pages = spark.createDataFrame([("a", "ok"), ("a", "ok"), ("b", "bad"), ("b", "ok")], "d string, class string")
    assert [tuple(r) for r in audits.class_counts(pages, "d", "class", ["ok", "review", "bad"]).orderBy("place").select("class", "pages", "documents").collect()] == [("ok", 3, 2), ("review", 0, 0), ("bad", 1, 1)]
    scripts = audits.script_report(spark.createDataFrame([("a", "नियम ab"), ("b", "12"), ("c", None)], "d string, t string"), "d", F.col("t")).orderBy("d").collect()
    assert [r["ratio"] for r in scripts] == [4 / 6, None, None]

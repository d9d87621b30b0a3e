"""References, answer checks and chunks on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from lekhaspark.functions import chunks as C
from lekhaspark.functions import questions as Q
from lekhaspark.functions import references as R
from lekhaspark.functions import text as T
from lekhaspark.operators import answers as A


def test_reference_dates(spark):
    want = {"15 सितम्बर, 2023": "2023-09-15", "31.02.2026": "None", "21/9/26": "2026-09-21", "5 March 1949": "None", "१०.०९.२०२६": "2026-09-10", "": "None", "10 foo 2020": "None"}
    df = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r[0]: str(r[1]) for r in df.select("x", R.reference_date(F.col("x"))).collect()} == want


def test_order_references(spark):
    rows = [
        ("a", "शासनादेश संख्या 42/2026/77, दिनांक 21.07.2026 को संशोधित किया जाता है। संख्या 5/2019/1 दिनांक 05.01.2019 निरस्त"),
        ("b", "No. 7/2020/1 dated 3 March 2020 see. No. 7/2020/1 dated 3 March 2020 is rescinded"),
        ("c", "No. 9/2021/3 dated 01.02.2021 own header"),
        ("d", None), ("e", ""), ("f", "no reference, but No. 12 here"),
    ]
    df = spark.createDataFrame([(*r, "9/2021/3", datetime.date(2021, 2, 1)) for r in rows], "id string, text string, number string, day date")
    got = {(r["id"], r["go_key"], str(r["go_date"]), r["kind"]) for r in R.order_references(df, "id", "text", "number", "day").collect()}
    assert got == {("a", "42/2026", "2026-07-21", "amends"), ("a", "5/2019", "2019-01-05", "cancels"), ("b", "7/2020", "2020-03-03", "cancels")}
    evidence = [r["evidence"] for r in R.order_references(df.where("id = 'f' or id = 'c'"), "id", "text").collect()]
    assert evidence == [rows[2][1]]
    assert R.order_references(df.limit(0), "id", "text").count() == 0


def test_resolved(spark):
    refs = spark.createDataFrame([("x", "1/2020"), ("y", "1/2020"), ("z", "1/2020"), ("x", "2/2020"), ("x", "3/2020"), ("z", None)], "id string, go_key string").withColumn("go_date", F.lit("2020-01-01").cast("date"))
    orders = spark.createDataFrame([("x", "1/2020"), ("y", "1/2020"), ("q", "2/2020"), ("x", "3/2020")], "o string, go_key string").withColumn("go_date", F.lit("2020-01-01").cast("date"))
    got = {(r["id"], r["go_key"]): r["target"] for r in R.resolved(refs, "id", orders, "o").collect()}
    assert got == {("x", "1/2020"): "y", ("y", "1/2020"): "x", ("z", "1/2020"): None, ("x", "2/2020"): "q", ("x", "3/2020"): None, ("z", None): None}


def test_answers(spark):
    text = "1. Fee is 50,000 [S1 p.2]\nLimit ५०० days\n[S2 p.3]\nGrant 30% [S2 p.3]\nRate 7 must be checked against the original page [S3 p.1]\nRate 8 [S3 p.1]\nPlain words\nGFR 2017 rules\nOnly 9\nGone [S9 p.9]\nTotal 4 [S4 p.1]"
    answers = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    evidence = spark.createDataFrame([
        (1, "S1", 2, ["fee 50000", None], False), (1, "S2", 3, ["500 and 30", "500 30 x"], True), (1, "S3", 1, ["7 8"], True), (1, "S4", 1, ["5"], False),
    ], "id int, label string, page int, texts array<string>, risky boolean")
    named = spark.createDataFrame([(1, ["2017"])], "id int, numbers array<string>")
    units = A.claim_units(answers, "id", "text")
    lines = {r["unit"]: r["line"] for r in units.collect()}
    issues = {lines[r["unit"]]: r["issue"] for r in A.numeric_issues(units, "id", evidence, named).collect()}
    assert issues == {"Rate 8 [S3 p.1]": "unsafe", "Only 9": "uncited", "Total 4 [S4 p.1]": "unsupported"}
    assert [tuple(r) for r in A.invalid_citations(units, "id", evidence).collect()] == [(1, "S9", 9)]


def test_masked_numbers(spark):
    df = spark.createDataFrame([("pay 30 % or 1,200/- in २०२०", True), ("pay 30", False), (None, True)], "x string, risky boolean")
    assert [r[0] for r in df.select(A.masked_numbers(F.col("x"), F.col("risky"))).collect()] == ["pay or /- in", "pay 30", None]


@pytest.mark.parametrize("text", ["", " ", "short", "word " * 1000, "x" * 5000, "Satz eins. Satz zwei.\n\n" * 200, "एक वाक्य। " * 400])
def test_chunks(spark, text):
    rows = C.chunks(spark.createDataFrame([("d", text)], "id string, text string"), "id", "text").orderBy("chunk_index").collect()
    flat = spark.range(1).select(T.normalize_space(F.lit(text))).first()[0]
    spans = C.chunk_spans(flat)
    assert [r["text"] for r in rows] == [flat[s:e].strip() for s, e in spans]
    if flat:
        assert spans[0][0] == 0 and spans[-1][1] == len(flat)
        assert all(b[0] <= a[1] and b[1] > a[1] for a, b in zip(spans, spans[1:]))
        assert all(e - s <= 1400 + 250 + 2 for s, e in spans)


def test_chunk_breaks():
    text = "a" * 1300 + "\n\n" + "b" * 100 + ". " + "c" * 3000
    first, second = C.chunk_spans(text)[:2]
    assert first == (0, 1302) and second[0] == 1302 - 220
    assert C.chunk_spans("y" * 1650 + " " + "z" * 400)[0] == (0, 1651)


def test_search_terms(spark):
    stop = ["what", "are", "the", "as", "per", "rules", "rule"]
    rows = [("what are the bidders' past experience criteria as per GFR rules",), (" ".join(f"word{i}" for i in range(30)),), ("what are the rules",), (None,), ("a 5 क नियम gfr GFR",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(Q.search_terms(F.col("x"), stop)).collect()]
    assert got[0] == ["bidders", "past", "experience", "criteria", "gfr"] and len(got[1]) == 12 and got[2] == [] and not got[3]
    assert got[4] == ["क", "नियम", "gfr"]


def test_date_range(spark):
    today = datetime.date(2026, 9, 30)  # a Wednesday
    want = {
        "orders between 1 Jan 2026 and 05.02.2026": ("2026-01-01", "2026-02-05"), "21/09/2026 से 10/09/2026 तक": ("2026-09-10", "2026-09-21"),
        "since 21st sept 2026": ("2026-09-21", "2026-09-30"), "10.09.2026 or 15.09.2026": ("2026-09-10", "2026-09-15"), "15 september": ("2026-09-15", "2026-09-15"),
        "15 october": ("2025-10-15", "2025-10-15"), "21 सितम्बर 2026 के आदेश": ("2026-09-21", "2026-09-21"), "today": ("2026-09-30", "2026-09-30"), "कल के आदेश": ("2026-09-29", "2026-09-29"),
        "last 7 days": ("2026-09-24", "2026-09-30"), "पिछले ३ दिन": ("2026-09-28", "2026-09-30"), "last 999 days": ("2025-09-30", "2026-09-30"), "this week": ("2026-09-28", "2026-09-30"),
        "last week": ("2026-09-21", "2026-09-27"), "this month": ("2026-09-01", "2026-09-30"), "last month": ("2026-08-01", "2026-08-31"), "this year": ("2026-01-01", "2026-09-30"),
        "orders of august 2025": ("2025-08-01", "2025-08-31"), "december orders": ("2025-12-01", "2025-12-31"), "may i ask": None, "orders of 2025": ("2025-01-01", "2025-12-31"), "31 sept": ("2026-09-01", "2026-09-30"), "plain": None, "": None,
    }
    df = spark.createDataFrame([(k, today) for k in want], "x string, d date")
    got = {r[0]: r[1] and (str(r[1]["from"]), str(r[1]["to"])) for r in df.select("x", Q.date_range(F.col("x"), F.col("d"))).collect()}
    assert got == want

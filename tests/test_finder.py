import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lekhaspark.functions import glossary
from lekhaspark.operators import conversations, filters, finder, search

TODAY = "2026-09-27"
REGISTRY = [
    (50001, "Basic Education"), (50001, "बेसिक शिक्षा विभाग"), (34, "Public Works"), (34, "PWD"), (34, "लोक निर्माण विभाग"), (34, "लोक निर्माण"), (15, "Jail"), (15, "Prison"), (15, "कारागार विभाग"),
    (37, "Agriculture"), (37, "कृषि विभाग"), (37, "कृषि"), (162, "Finance"), (162, "वित्त विभाग"), (1, "Energy"), (1, "ऊर्जा विभाग"), (40, "Home"), (40, "गृह विभाग"), (39, "Agricultural Education and Research"),
]
D = datetime.date.fromisoformat
# question -> what its row has; None for no row
CASES = {
    "recent government order release in department of basic education": {"department": 50001, "date_from": None, "words": [], "mode": "recent"},
    "बेसिक शिक्षा विभाग के नवीनतम शासनादेश": {"department": 50001, "words": []},
    "latest orders of PWD": {"department": 34},
    "recent jail orders": {"department": 15},
    "latest order on solar pump subsidy": {"words": ["solar", "pump", "subsidy"], "similar": "solar pump subsidy सोलर सौर पम्प पंप अनुदान सब्सिडी"},
    "recent government orders released by Public Works Department or PWD": {"department": 34, "words": []},
    "recent orders of PWD (लोक निर्माण विभाग)": {"department": 34, "words": []},
    "लोक निर्माण विभाग / PWD के नवीनतम शासनादेश": {"department": 34, "words": []},
    "latest orders of कृषि विभाग / Agriculture": {"words": []},
    "Agriculture order released on 10th or 15th Sepetember": {"department": 37, "dates": [D("2026-09-10"), D("2026-09-15")], "words": []},
    "what does the latest order on DA say": None, "सोलर पंप लगवाने हेतु क्या-क्या प्रक्रिया है": None, "What are the seniority rules for medical officers?": None,
    "may i know the leave rules": None, "latest DA rate": None, "": None, None: None,
    "find GO 51/2026/918": {"mode": "find", "go_number": "51/2026/918", "words": []},
    "शासनादेश संख्या 158 / 2026": {"go_number": "158/2026"},
    "orders on 21/09/2026": {"go_number": None, "date_from": D("2026-09-21")},
    'find "फार्मर रजिस्ट्री"': {"phrases": ["फार्मर रजिस्ट्री"], "explicit": True},
    "solar* orders of agriculture": {"patterns": ["solar*"], "similar": "solar", "department": 37},
    "orders with *पंप*": {"patterns": ["*पंप*"]}, "find *solar पम्प*": {"patterns": ["*solar पम्प*"]}, "recent orders of PWD?": {"patterns": [], "department": 34},
    "orders released by कृषि अनुभाग-5": {"department": 37, "section": "कृषि अनुभाग-5"},
    "लोक निर्माण अनुभाग-1 द्वारा जारी शासनादेश": {"department": 34, "section": "लोक निर्माण अनुभाग-1"},
    "orders released by लोक निर्माण अनुभाग-1 this week": {"section": "लोक निर्माण अनुभाग 1", "date_from": D("2026-09-21"), "explicit": True},
    "orders issued by Public Works section 1 in September": {"section": "अनुभाग-1", "date_from": D("2026-09-01"), "department": 34},
    "Agriculture अनुभाग 5 के आदेश": {"section": "कृषि अनुभाग 5", "department": 37},
    "orders about farmer registry": {"words": ["farmer", "registry"]},
    "किसान सम्मान निधि से संबंधित शासनादेश": {"words": ["किसान", "सम्मान", "निधि"]},
    "search metro rail order": {"explicit": True},
    "is there any order on work from home?": {"department": None, "words": ["work", "home"]},
    "recent orders of finance": {"department": 162},
    "What is the DA rate in the latest order?": None,
    "what are the recent orders of PWD": {"mode": "recent"},
    "सोलर पंप के लिए शासन द्वारा जारी शासनादेश": {"words": ["सोलर", "पंप"], "person": None},
    "orders released by Ravi Ranjan": {"person": "ravi ranjan", "mode": "find"},
    "GeM guidelines": {"topics": ["gem"], "words": [], "mode": "find"},
    "central government procurement rules": {"topics": ["procurement"], "jurisdictions": ["IN"]},
    "payment terms guideline in GFR": None,
    "Agriculture, 15.09.2023": {"department": 37, "date_from": D("2023-09-15"), "date_to": D("2023-09-15")},
    "support orders of UP": {"jurisdictions": ["UP"], "words": ["support"]},
}


@pytest.fixture(scope="module")
def parsed(spark):
    asked = spark.createDataFrame(list(enumerate(CASES)), "query int, question string")
    rows = finder.parse(asked, spark.createDataFrame(REGISTRY, "entry int, phrase string"), TODAY).collect()
    questions = list(CASES)
    assert len({r["query"] for r in rows}) == len(rows)
    return {questions[r["query"]]: r for r in rows}


def test_questions_for_orders(parsed):
    wrong = {}
    for question, want in CASES.items():
        row = parsed.get(question)
        if want is None or row is None:
            if want is not None or row is not None:
                wrong[question] = row
        else:
            got = {k: row[k] for k in want}
            if got != want:
                wrong[question] = got
    assert wrong == {}


def test_question_as_filters(spark, parsed):
    docs = spark.createDataFrame(
        [("a", "कृषि विभाग", 37, "सोलर पम्प हेतु अनुदान", "51/2026/918", True), ("b", "कृषि विभाग", 37, "बीज", "6/2025", True), ("c", "Agriculture", 37, "solar lamp", None, True), ("d", "Home", 40, "सोलर", None, True)],
        "source_id string, department string, department_id int, subject string, go_number string, provenance_ok boolean",
    ).selectExpr("*", "'UP' as jurisdiction_code", "array('gem') as topics", "'portal' as provider", "'{}' as metadata", "'' as section", "'' as category")
    ids = lambda q, **names: sorted(r["source_id"] for r in filters.scope(docs, finder.request(parsed[q], names.get("names"))).collect())
    assert ids("solar* orders of agriculture", names={37: ["Agriculture", "कृषि विभाग"]}) == ["a", "c"]
    assert ids("find GO 51/2026/918") == ["a"] and ids("latest order on solar pump subsidy") == ["a"]


def test_glossary():
    assert glossary.pattern_spellings("*solar पम्प*") == ["*solar पम्प*", "*सोलर पम्प*", "*सौर पम्प*"]
    assert len(glossary.pattern_spellings("solar pump subsidy")) == 6 and glossary.pattern_spellings("x*") == ["x*"]
    assert glossary.spellings()["अनुदान"] == ["subsidy", "subsidies", "अनुदान", "सब्सिडी", "grant", "grants"]


def brute_covers(places, least):
    """Every stretch from one place to another, kept if it has enough terms and neither end can go."""
    out = 0.0
    enough = lambda a, b: len({t for _, t in places[a : b + 1]}) >= least
    for a in range(len(places)):
        for b in range(a, len(places)):
            if enough(a, b) and not enough(a + 1, b) and not enough(a, b - 1):
                out += 0.1 / (1 + places[b][0] - places[a][0] - (b - a))
    return out


def test_cover_density(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(120):
        places = sorted((at, rng.choice("abcd"[: 1 + k % 4])) for at in rng.sample(range(1, 60), rng.randint(1, 20)))
        least = rng.randint(1, 4)
        rows.append((k, places, least))
        want[k] = brute_covers(places, least)
    df = spark.createDataFrame(rows, "k int, places array<struct<at: int, term: string>>, least int")
    got = {r["k"]: r["x"] for r in df.select("k", search.cover_density(F.col("places"), F.col("least")).alias("x")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cover_ranks(spark):
    docs = spark.createDataFrame([(1, "solar x x pump"), (2, "solar pump and solar"), (3, "pump"), (4, None), (5, "")], "d int, text string")
    asked = spark.createDataFrame([("q", "the solar pump"), ("z", "")], "q string, asked string")
    both = search.cover_ranks(docs, "d", "text", asked, "q", "asked", ["the"], None).orderBy("rank").collect()
    assert [(r["d"], r["rank"]) for r in both] == [(2, 1), (1, 2)]
    assert abs(both[1]["score"] - 0.1 / 3 / (1 + math.log(4))) < 1e-6 and abs(both[0]["score"] - (0.1 + 0.1 / 2) / (1 + math.log(4))) < 1e-6
    assert search.cover_ranks(docs, "d", "text", asked, "q", "asked", ["the"]).count() == 3


def test_follow_ups(spark):
    turns = [("a", 1, "user", "What is earned leave?"), ("a", 2, "assistant", "x"), ("a", 3, "user", "And for teachers?"), ("a", 5, "user", "  "), ("a", 7, "user", "इसके लिए शासनादेश"), ("a", 9, "user", "Rules of pension"), ("a", 11, "user", "a rule that holds"), ("a", 13, "user", "does that rule hold"), ("b", 1, "user", "And this?"), ("b", 3, "user", "long " * 200), ("b", 5, "user", "what about it"), ("c", 1, "user", None)]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in conversations.contextual_questions(df).collect()}
    assert {k for k, r in got.items() if r["contextualized"]} == {("a", 3), ("a", 7), ("a", 13), ("b", 5)}
    assert got["a", 3]["retrieval_query"] == "Current question: And for teachers?\nPrevious user question 1: What is earned leave?"
    assert got["a", 7]["retrieval_query"].endswith("Previous user question 1: What is earned leave?\nPrevious user question 2: And for teachers?")
    assert got["b", 5]["retrieval_query"].endswith("…") and got["c", 1]["retrieval_query"] == "" and got["b", 1]["retrieval_query"] == "And this?"
    picked = {(r["conv_id"], r["turn"]) for r in conversations.contextual_questions(df, F.col("turn") == 9).collect() if r["contextualized"]}
    assert ("a", 9) in picked

from pyspark.sql import functions as F

from lekhaspark.functions import classification as C
from lekhaspark.operators.answers import last_whole_sentence, whole_sentences


def classes(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, c string, p string")
    got = df.select("i", C.classify_order(F.col("s"), F.col("c"), F.col("p"), rulebooks=("book", "handbook"), portal="portal").alias("x")).orderBy("i").collect()
    return [(r.x.doc_type, r.x.tier, r.x.confidence) for r in got]


def test_classes(spark):
    got = classes(
        spark,
        (None, None, None),
        ("", "policy", "book"),
        ("anything", "unknown", "handbook"),
        (None, None, "central"),
        ("अनुस्मारक: सेवा नियमावली", None, "portal"),
        ("श्री राम को अवकाश", "", ""),
        ("प्रदेश के समस्त थाना भवनों का", "", ""),
        ("उद्योग नीति-2022 के अन्तर्गत", "", ""),
        ("Transfer and posting of officers", "", ""),
        ("परियोजना", "नीतिगत", ""),
    )
    assert got == [
        ("other", "B", "low"), ("policy", "A", "high"), ("guideline", "A", "high"), ("guideline", "A", "low"), ("rules", "A", "high"),
        ("case-specific", "C", "high"), ("general-instruction", "A", "low"), ("other", "B", "low"), ("case-specific", "C", "high"), ("guideline", "A", "low"),
    ]


def test_spelling(spark):
    df = spark.createDataFrame([("ड़‍   ऩ\n",), (None,)], "s string")
    assert [r[0] for r in df.select(C.line(F.col("s"))).collect()] == ["ड़ ऩ", ""]


def test_topics(spark):
    df = spark.createDataFrame([("GeM portal", ["budget"]), ("gems", None), ("यgem", []), (None, ["conduct", "none"])], "s string, k array<string>")
    got = [r[0] for r in df.select(C.topics(F.col("s"), catalogue=F.col("k"))).collect()]
    assert got == [["procurement", "gem", "financial-rules", "budget-accounts"], [], ["procurement", "gem"], ["conduct-discipline"]]


def test_admission(spark):
    rows = [("Tender notice", None, False), ("Tender guidelines", None, False), ("Camp held", "rules", False), ("सूचना", None, True), (None, None, None), ("Seniority list of clerks", "go", None)]
    df = spark.createDataFrame(rows, "t string, l string, d boolean")
    got = [tuple(r[0]) for r in df.select(C.admission(*map(F.col, "tld"))).collect()]
    assert got == [(False, "notice", "tender"), (True, "guideline", None), (True, "act-rules", None), (False, "notice", "district notice"), (True, "other", None), (False, "go", "seniority/gradation list")]


def test_whole_sentences(spark):
    cases = {
        "One. Two thr": "One.",
        "It is 2.5 an": "",
        "A है। [S1 p.2] फिर": "A है। [S1 p.2]",
        "Done.\nThe conditions are:\n\n1. ": "Done.\nThe conditions are:\n\n1.",
        "Done.\nThe conditions are:\n\n- wo": "Done.",
        "A [see p. 3 and": "",
        "": "",
    }
    assert {k: last_whole_sentence(k) for k in cases} == cases
    df = spark.createDataFrame([("One. Two",), (None,)], "s string")
    assert [r[0] for r in df.select(whole_sentences("s")).collect()] == ["One.", None]

import pytest

from lekhaspark.operators import answers as A
from lekhaspark.operators import salvage as S

WORKS = ("S1", 132, ["mobilisation advance at 10 (ten) per cent of the contract price, interest-bearing"], False)
GENERAL = ("S1", 3, ["Purchase of goods without quotation: general conditions for the purchase committee and the buyer."], False)
LIMITS = ("S2", 155, ["Purchase of goods without quotation up to the value of Rs 50,000 on each occasion may be made by the competent authority."], False)
HINDI = ("S1", 1, ["कार्य की गुणवत्ता"], True)
CENTRAL = "**Central Government Context:** These rules apply to central entities [S1 p.1].\n" + "\n".join(f"- Bidders need {n} similar works of {n}0% value [S1 p.1]." for n in (3, 2, 1, 4))


@pytest.fixture(scope="module")
def frames(spark):
    def build(rows):
        answers = spark.createDataFrame([(k, a) for k, (a, _) in rows.items()], "k string, text string")
        evidence = spark.createDataFrame([(k, *p) for k, (_, pages) in rows.items() for p in pages], "k string, label string, page int, texts array<string>, risky boolean")
        return answers, evidence

    return build


def test_salvage(frames):
    rows = {
        "list": ("• Mobilisation advance is 10 per cent of the contract price [S1 p.132].\n• It is recovered in 7 instalments [S1 p.132].\n• It is given for capital-intensive works [S1 p.132].", [WORKS]),
        "one": ("कुल 45 पद स्वीकृत हैं [S1 p.1]।\nकार्य की गुणवत्ता की जिम्मेदारी कार्यदायी संस्था की होगी। [S1 p.1]", [HINDI]),
        "sliver": (CENTRAL, [("S1", 1, ["central entities"], True)]),
        "none": ("Nothing is cited here at all.", [WORKS]),
        "wrong page": ("The advance is interest-bearing in all cases [S9 p.1].", [WORKS]),
        "leaning": ("Moreover the advance bears interest [S1 p.132]. The advance bears an interest too [S1 p.132].", [WORKS]),
        "mark": ("The advance is [UNVERIFIED_NUMERIC] of the price [S1 p.132]. The advance bears an **interest too [S1 p.132].", [WORKS]),
        "later": ("The advance is 10 per cent of the price. It is interest-bearing in all cases [S1 p.132]", [WORKS]),
        "empty": ("", [WORKS]), "null": (None, [WORKS]),
    }
    got = {r["k"]: r for r in S.salvage(*frames(rows)[:1], "k", "text", frames(rows)[1]).collect()}
    assert got["list"]["salvaged"] == "• Mobilisation advance is 10 per cent of the contract price [S1 p.132].\n• It is given for capital-intensive works [S1 p.132]."
    assert got["one"]["salvaged"] == "कार्य की गुणवत्ता की जिम्मेदारी कार्यदायी संस्था की होगी। [S1 p.1]"
    assert got["sliver"]["kept"] == 1 and got["sliver"]["sentences"] == 5 and got["sliver"]["salvaged"] == ""
    assert [got[k]["salvaged"] for k in ("none", "wrong page", "empty", "null")] == [""] * 4
    assert got["leaning"]["salvaged"] == "The advance bears an interest too [S1 p.132]."
    assert got["mark"]["salvaged"] == "The advance bears an interest too [S1 p.132]." and got["mark"]["sentences"] == 1
    assert got["later"]["salvaged"].count("•") == 2


def test_missing_citations(frames, spark):
    rows = {
        "wrong": ("• Goods may be purchased without quotation up to Rs 50,000 on each occasion [S1 p.3].", [GENERAL, LIMITS]),
        "invented": ("• The limit is Rs 75,000 for each purchase of goods without quotation [S1 p.3].", [GENERAL, LIMITS]),
        "unrelated": ("• Fees are Rs 50,000 [S1 p.3].", [GENERAL, LIMITS]),
        "none": ("Goods without quotation on each occasion up to Rs 50,000", [GENERAL, LIMITS]),
        "two": ("Goods without quotation on each occasion: Rs 50,000. Fine. Goods without quotation on each occasion cost Rs 50,000!", [GENERAL, LIMITS]),
        "risky": ("Goods without quotation on each occasion up to Rs 50,000", [(*LIMITS[:3], True)]),
        "agreed": ("Goods without quotation on each occasion up to Rs 50,000", [("S2", 155, [LIMITS[2][0], "goods of 50000"], True)]),
    }
    answers, evidence = frames(rows)
    got = {r["k"]: (r["answer"], r["added"]) for r in S.add_citations(answers, "k", "text", evidence).collect()}
    assert got["wrong"] == ("• Goods may be purchased without quotation up to Rs 50,000 on each occasion [S1 p.3] [S2 p.155].", 1)
    assert all(got[k] == (rows[k][0], 0) for k in ("invented", "unrelated", "risky"))
    assert got["none"] == (rows["none"][0] + " [S2 p.155]", 1) and got["agreed"][1] == 1
    assert got["two"] == ("Goods without quotation on each occasion: Rs 50,000 [S2 p.155]. Fine. Goods without quotation on each occasion cost Rs 50,000 [S2 p.155]!", 2)
    fixed = S.add_citations(answers, "k", "text", evidence).where("k = 'wrong'").withColumnRenamed("answer", "text")
    assert A.numeric_issues(S.sentence_units(fixed, "k", "text"), "k", evidence).count() == 0
    named = spark.createDataFrame([("none", ["50000"])], "k string, numbers array<string>")
    assert {r["k"]: r["added"] for r in S.add_citations(answers, "k", "text", evidence, named).collect()}["none"] == 0

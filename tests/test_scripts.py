import random

from pyspark.sql import functions as F

from lekhaspark.functions import legacy_font as L
from lekhaspark.functions import transliteration as T
from lekhaspark.operators import suggest

# What lines of printed glyphs say.
PRINTED = [
    ("foŸkh; vf/kdkj¨a dk izfrfu/kk;u", "वित्तीय अधिकारों का प्रतिनिधायन"), ("foÙkh; gLriqfLrdk [k.M&ik¡p Hkkx&1", "वित्तीय हस्तपुस्तिका खण्ड-पाँच भाग-1"),
    ("dk;kZy;k/;{k", "कार्यालयाध्यक्ष"), ("/kkfeZd", "धार्मिक"), ("dkÆed", "कार्मिक"), ('okÆ"kd', "वार्षिक"), ("fLFkfr", "स्थिति"), ("g¨rs", "होते"), ("y®d", "लोक"),
    ("mŒÁŒ", "उ०प्र०"), ("vko’;drk", "आवश्यकता"), ("dysDVªsV", "कलेक्ट्रेट"), ("d¨Ã", "कोई"), ("LohÑr", "स्वीकृत"), ("ifjizs{;", "परिप्रेक्ष्य"), ("ekWMy", "मॉडल"),
    ("`5,000", "₹5,000"), ("5,000 ,d", "5,000 एक"), ("ZZ", "र्"), ("f", "ि"),
]
MIXED = [
    ("ekudksa ¼Standards of Financial Propriety½ dk", "मानकों (Standards of Financial Propriety) का"), ("vf/kdkfj;ksa ¼DDO½ dks", "अधिकारियों (DDO) को"),
    ("dj ¼Self assessment tax½ gsrq", "कर (Self assessment tax) हेतु"), ("erns; ¼Voted½A", "मतदेय (Voted)।"), ("¼Form 16½ esa", None),
]


def test_legacy_glyphs(spark):
    df = spark.createDataFrame([(a, b) for a, b in PRINTED + MIXED] + [(None, None), ("", "")], "a string, b string")
    got = {r["a"]: (r["x"], r["b"]) for r in df.select("*", L.legacy_to_unicode("a").alias("x")).collect()}
    assert got[None][0] is None and got[""][0] == ""
    assert {a: x for a, (x, b) in got.items() if b is not None and x != b} == {}
    # a run of English ends at a bracket
    assert got["¼Form 16½ esa"][0].endswith(" में")


def test_legacy_round_trip():
    rng = random.Random(3)
    letters = [u for u in "कखगघचछजझञटठडढणतथदधनपफबभमयरलवशषसह"]
    for _ in range(400):
        word = ""
        for _ in range(rng.randint(1, 5)):
            word += rng.choice(["", "", "र्", "स्"]) + rng.choice(letters) + rng.choice(["", "ा", "ि", "ी", "ु", "ू", "े", "ो", "ं", "िं"])
        # glyphs may look like an English word, so words are read one by one
        assert L._word(L.encode(f"{word}।")) == f"{word}।", (word, L.encode(word))


def test_legacy_tags():
    page = '<p>Rule <FONT FACE="Kruti Dev 020">foŸkh; <b>¼lkekU;½</b></FONT> and <font color=red>dk</font> <font face=DevLys>d &lt; <font>dk</font></font> dk</p>'
    want = '<p>Rule <FONT FACE="Kruti Dev 020">वित्तीय <b>(सामान्य)</b></FONT> and <font color=red>dk</font> <font face=DevLys>क ढ <font>का</font></font> dk</p>'
    assert L.convert_tags(page) == want
    assert L.convert_tags("<font face=Arial>dk</font></font>") == "<font face=Arial>dk</font></font>"


def test_transliteration_keys(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert {w: one(T.romanize, w) for w in ("शासनादेश", "क्या", "पंप", "हिंदी", "ज़मीन")} == {"शासनादेश": "shaasanaadesh", "क्या": "kyaa", "पंप": "pamp", "हिंदी": "hindee", "ज़मीन": "zameen"}
    assert {w: one(T.phonetic, w) for w in ("kya", "prakriya", "hindi", "yojana", "ghar", "kae", "AAAI")} == {"kya": "क्या", "prakriya": "प्रक्रिया", "hindi": "हिंदी", "yojana": "योजना", "ghar": "घर", "kae": "कए", "AAAI": "आऐ"}
    assert one(T.loose_key, "Phool-Waala") == "fulvala" and one(T.schwa_key, "yojana") == "yojn" and one(T.consonant_key, "dhaan") == "dn"


def test_suggestions(spark):
    known = suggest.lexicon(spark.createDataFrame([(w, n) for w, n in (("शासनादेश", 9), ("योजना", 5), ("में", 50), ("बेसिक", 40), ("पंप", 3), ("पम्प", 8), ("शासन", 90), ("नहीं", 7), ("नहीं", 1))], "word string, weight long"))
    aliases = spark.createDataFrame([("mein", "में")], "latin string, word string")
    typed = spark.createDataFrame([(w,) for w in ("shasnadesh", "yojna", "mein", "men", "me", "nahi", "abhishek", "pump", "shasa", "12", "pamp")], "latin string")
    got = {}
    for r in suggest.suggest(typed, known, aliases).orderBy("latin", "place").collect():
        got.setdefault(r["latin"], []).append(r["word"])
    assert got["shasnadesh"][0] == "शासनादेश" and got["yojna"][0] == "योजना" and got["mein"][0] == "में" == got["men"][0] == got["me"][0] and got["nahi"][0] == "नहीं"
    assert "बेसिक" not in got["abhishek"] and got["pamp"][:2] == ["पम्प", "पंप"] and "12" not in got
    assert got["pump"][-1] == T_phonetic("pump") and max(map(len, got.values())) <= 5
    done = suggest.complete(typed, known).collect()
    assert {r["word"] for r in done if r["latin"] == "shasa"} == {"शासन", "शासनादेश"} and [r["word"] for r in done if r["latin"] == "shasa" and r["place"] == 1] == ["शासन"]
    assert not [r for r in done if r["latin"] == "me"]


def T_phonetic(word):
    import re

    for a, b in T.PHONETIC:
        word = re.sub(a, b, word)
    return word

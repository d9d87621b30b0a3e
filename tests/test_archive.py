import json

import pytest
from pyspark.sql import functions as F

from lekhaspark.functions import layout
from lekhaspark.functions import pages as P
from lekhaspark.functions import unicode as U
from lekhaspark.operators import checks, duplicates, filters, hits, records


def each(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_unicode_forms(spark):
    assert each(spark, U.nfc, ["é", None, "क़"]) == ["é", None, "क़"]
    assert each(spark, U.match_form, ["Ｆｉｌｅ №５,  «x»", "ﬁn"]) == ["file no5 x", "fin"]
    assert each(spark, U.normal_text, [" é\r\n\n\n\nb "]) == ["é\n\nb"]
    assert each(spark, U.strip_nul, ["a\x00b"]) == ["ab"]
    assert each(spark, U.department_key, ["चिकित्‍सा  शिक्षा", " HOME "]) == ["चिकित्सा शिक्षा", "home"]
    assert each(spark, U.department_id, ["1#25#3#2020", "core-1", "1#2#3"]) == [25, None, None]


def test_patterns_are_literal_where_users_type():
    assert filters.like_escape("50%_a\\b") == "50\\%\\_a\\\\b" and filters.wildcard_to_like("a**b?c%") == "a%b_c\\%"
    assert filters.section_pattern("कृषि अनुभाग-1").endswith("([^0-9]|$)")
    assert filters.variants("solar pump", {"solar": ["x", "y"], "pump": ["z"]}) == ["solar pump", "x pump", "y pump", "solar z", "x z", "y z"]


def test_filters_of_bad_requests(spark):
    df = spark.createDataFrame([("a", "UP"), ("b", None)], "source_id string, jurisdiction_code string")
    assert df.where(filters.by_jurisdiction([])).count() == 2 and df.where(filters.by_jurisdiction(["u", "upx"], True)).count() == 2
    assert df.where(filters.by_source_ids([])).count() == 0 and df.where(filters.by_source_ids(None)).count() == 2
    assert df.where(~filters.by_jurisdiction(["up"])).count() == 1
    with pytest.raises(ValueError):
        filters.by_verification(df, df, "checked")


def test_dates_and_numbers_of_listings(spark):
    assert each(spark, P.long_date, ["Aug 30, 2019", "Sept 1, 2020", "August 30, 1946", "Foo 3, 2020", "on May 5,2021 x"]) == ["2019-08-30", "2020-09-01", None, None, "2021-05-05"]
    assert each(spark, P.day_first_date, ["30-08-2019", "1.2.2020", "1/13/2020", "32/1/2020", ""]) == ["2019-08-30", "2020-02-01", None, None, None]
    assert each(spark, P.day_month_year, ["12 Jun 2024", "3rd August, 1999", "3 Foo 1999", "0 Jan 2000"]) == ["2024-06-12", "1999-08-03", None, None]
    assert each(spark, P.any_date, ["x 12 Jun 2024", "no"]) == ["2024-06-12", None]
    good = ["1728/नौ-9-2020-161ज/2012", "G-4-484/X-90-216-79", "संख्या-1889/33-3-20", "823/78-2-2021-254 L.C/2019TC"]
    assert each(spark, P.looks_like_number, good) == [True] * 4
    assert each(spark, P.looks_like_number, ["12/06/2024", "abc", "12", "a rule on 3/4 of many a thing here and there"]) == [False] * 4
    assert each(spark, P.explicit_source_id, ["see 12#3#4#2020.", "12#3#4#20"]) == ["12#3#4#2020", None]


def test_html_pieces(spark):
    assert each(spark, P.plain_text, ["<p>a&nbsp;&amp;<br>b</p><script>x<y</script>&#2325;&#x41;&#99999999;"]) == ["a & b कA&#99999999;"]
    assert each(spark, P.block_text, ["<h1>T</h1><table><tr><td>a</td><td>b <b>c</b></td></tr></table><p>x<br>y"]) == ["T\na | b c\nx\ny"]
    assert each(spark, P.heading, ["१२\nRule 5 of many\nx"]) == ["Rule 5 of many"]
    pdf = ["<iframe src='/a.html'></iframe><embed src='/x.pdf#p=2'>", "<object data='/getfile?x=1&amp;y=2'>", "<p>"]
    assert each(spark, P.embedded_pdf, pdf) == ["/x.pdf", "/getfile?x=1&y=2", None]


def test_page_layouts(spark):
    left, right = [f"left line {k:02d} of the text" for k in range(12)], [f"right line {k:02d} of the text" for k in range(12)]
    page = "\n".join(f"{a:<40}{b}" for a, b in zip(left, right))
    assert each(spark, layout.one_column, [page, "one\ncolumn", None]) == ["\n".join(left) + "\n\n" + "\n".join(right), "one\ncolumn", None]
    table = "\n".join(f"{'cell':<26}{'cell':<26}{'cell':<26}" for _ in range(12))
    assert each(spark, layout.gutter, [table, page]) == [None, each(spark, layout.gutter, [page])[0]] and each(spark, layout.gutter, [page])[0] is not None
    legacy = "mRrj izns'k 'kklu ds vkns'k esa dgk x;k gS fd ;g fu;e ls ykxw gS vkSj bl dks ij fy, ;k rFkk gS"
    assert each(spark, P.legacy_font, [legacy, "the rule of the state is to be in force for all of the year and on", "नियम " * 20]) == [True, False, False]
    good = "नियम क्या कहता है यह स्पष्ट रूप से लिखा है " * 3
    assert each(spark, P.garbled, [good, "ऄ ऄ " + good, "ा नियम ि नियम ी नियम " * 8, "short"]) == [False, True, True, False]
    assert each(spark, lambda c: P.shorten(c, 20), ["short", "a word or two and more of them", "x" * 30]) == ["short", "a word or two and …", "x" * 20 + " …"]
    assert each(spark, P.well_formed_hindi, ["नियम", "ानियम", "निि", "abc"]) == [True, False, False, False]
    assert each(spark, P.highlight_terms, ["GO on नि का of Rule rule"]) == [["नि", "का", "rule"]]


def test_choice_and_labels(spark):
    df = spark.createDataFrame([("", "ocr text of the page", True), ("n" * 80, "o" * 99, True), ("", "ocr", False), ("abc", "ab", True)], "n string, o string, d boolean")
    assert [r["c"]["source"] for r in df.select(P.page_choice(F.col("n"), F.col("o"), F.col("d")).alias("c")).collect()] == ["ocr", "native", "native", "native"]
    label = lambda c: P.collection_label(c, {"core-": "Rules", "c": "Other"}, "Portal")
    assert each(spark, label, ["core-1", "c-2", "12#3"]) == ["Rules", "Other", "Portal"]
    assert each(spark, lambda c: P.authority_label(c, F.lit("B"), ["core"]), ["core", "x"]) == ["RULEBOOK", "CONTEXT"]
    assert each(spark, lambda c: P.jurisdiction_label(c, {"IN": "India"}), ["IN", "DL", "", None]) == ["India", "DL (state)", "unknown", "unknown"]
    assert each(spark, lambda c: P.reference_line(c, F.to_date(F.lit("2020-02-03"))), ["1/2", ""]) == ["1/2, 03.02.2020", "03.02.2020"]
    assert each(spark, lambda c: P.display_time(c.cast("timestamp"), "Asia/Kolkata"), ["2020-01-01 20:00:00"]) == ["02.01.2020 01:30"]
    assert each(spark, lambda c: P.needs_ocr(F.lit(500), c == "y"), ["y", "n"]) == [False, True]


def test_duplicates_in_order_of_certainty(spark):
    schema = "source_id string, file_hash string, text_hash string, go_number string, go_date string, text string"
    words = " ".join(f"word{k}" for k in range(30))
    known = [("k1", "f1", "t1", "12/x", "2020-01-01", words), ("k2", "f1", "t2", "13/x", "2020-01-01", "short"), ("k3", None, None, "12/y", "01/01/2020", words.replace("word1", "other"))]
    new = [("a", "f1", "t1", None, None, ""), ("b", "f9", "t1", None, None, ""), ("c", "f8", "t8", "12/z", "2020-01-01", words + " more"), ("d", None, None, "13", "2020-01-01", words), ("e", None, None, "12", "2020-01-01", " ".join(f"no{k}" for k in range(30))), ("f", None, None, "99", "2020-01-01", words)]
    got = duplicates.find_duplicates(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema)).collect()
    assert {r["source_id"]: (r["kind"], r["of"]) for r in got} == {"a": ("exact", "k2"), "b": ("exact", "k1"), "c": ("same-order", "k1"), "d": ("possible", "k2")}
    assert {r["source_id"]: r["reason"] for r in got}["a"] == "same file"
    df = spark.createDataFrame([("abcdef", "abXdeYZ"), ("", ""), ("a", "a")], "a string, b string")
    assert [[tuple(x) for x in r[0]] for r in df.select(duplicates.changed_ranges(F.col("a"), F.col("b"))).collect()] == [[(2, 3), (5, 7)], [], []]


def test_answers_without_an_answer(spark):
    no = "NO_ANSWER_IN_EVIDENCE"
    drafts = [no, f"{no} " + "The order of 2020 sets the rate at five percent for all farmers. " * 4, f"{no} The provided pages do not contain it. " + "Also a long remark on other things that they hold. " * 5, "The rate is 5."]
    assert each(spark, checks.no_answer, drafts) == [True, False, True, False]
    prose = ["The evidence does not mention it. No information on it.", "The order sets it. The evidence does not mention more.", "There is no information.", "None of the pages help. It does not address this. It is about roads. It is about rails. It is about ships."]
    assert each(spark, checks.prose_non_answer, prose) == [True, False, False, True]
    assert each(spark, checks.without_token, [f"a {no}\n\n\n\nb"]) == ["a \n\nb"]
    assert each(spark, lambda c: checks.names_the_question(F.lit("Rules on solar pumps for farmers"), c), ["Solar pumps scheme", "Solar order", None]) == [True, False, False]


def test_officer_departments(spark):
    e = spark.createDataFrame([(1, "Home  Department"), (2, "Forest"), (3, None)], "query int, department string")
    d = spark.createDataFrame([(1, "home department"), (2, "Home"), (3, "Home")], "query int, department string")
    assert [r[0] for r in checks.from_departments(e, d).collect()] == [1]


def test_records(spark, tmp_path):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(records.json_merge(F.lit('{"b":"1","a":"2"}'), F.lit('{"b":"3"}'))) == '{"a":"2","b":"3"}' and one(records.json_merge(F.lit(None), F.lit('{"b":"3"}'))) == '{"b":"3"}'
    assert one(records.json_texts(F.lit("{}"), "$.x")) == [] and one(records.json_has(F.lit('{"x":["a"]}'), "$.x", F.lit("a"), "string"))
    assert records.unnest(spark.createDataFrame([([1, 2], ["a"])], "a array<int>, b array<string>"), "a", "b").collect() == [(1, "a"), (2, None)]
    messages = spark.createDataFrame([(1, 7, "assistant"), (2, 7, "user"), (3, 8, "assistant")], "message_id int, user_id int, role string")
    kept = spark.createDataFrame([(7, 1, "up"), (8, 3, "up")], "user_id int, message_id int, rating string")
    asked = spark.createDataFrame([(7, 1, "down"), (7, 2, "up"), (7, 3, "up"), (8, 3, None)], "user_id int, message_id int, rating string")
    assert records.set_feedback(messages, kept, asked).collect() == [(7, 1, "down")]
    talks = spark.createDataFrame([(1, False, 5, False), (2, True, 3, False), (3, False, 9, False), (4, True, 1, True), (5, False, 2, True)], "conv_id int, pinned boolean, updated_at int, archived boolean")
    assert [r[0] for r in records.conversation_list(talks).collect()] == [2, 3, 1] and [r[0] for r in records.conversation_list(talks, True).collect()] == [5, 4]
    out, log = str(tmp_path / "t"), str(tmp_path / "log")
    records.replace_table(spark.range(5), out)
    assert records.logged_run(spark.range(7), out, log, "load")["rows"] == 7 and spark.read.parquet(out).count() == 7
    with pytest.raises(Exception):
        records.logged_run(spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")), out + "2", log, "bad")
    assert {(r["run"], r["status"], r["rows"]) for r in spark.read.json(log).collect()} == {("load", "completed", 7), ("bad", "failed", 0)}
    assert one(records.clamp(F.lit("Other Thing"), ["a"], {}, "other")) == "other" and json.loads(one(F.to_json(records.model_reply(F.lit("x {\"a\": 1}"), "a int")))) == {"a": 1}


def test_hits_of_empty_tables(spark):
    h = spark.createDataFrame([], "query int, page int, variant int, rank int")
    assert hits.rerank_pool(h, 3, 3).count() == hits.alternates(h, h).count() == 0


def test_old_pages_and_scopes(spark):
    raw = [b"<meta charset=utf-8>\xc3\xa9", b"<p>\x97 dash", b"<meta charset='iso-8859-5'>\xd0", None]
    df = spark.createDataFrame([(k, bytearray(b) if b else None) for k, b in enumerate(raw)], "i int, b binary")
    assert [r["t"] for r in df.select("i", P.decode_page("b").alias("t")).orderBy("i").collect()] == ["<meta charset=utf-8>é", "<p>— dash", "<meta charset='iso-8859-5'>а", None]
    assert each(spark, P.old_references, ["a &#151; b&#146;s &#129; &#200;"]) == ["a — b’s &#129; &#200;"]
    rows = [("1#2#3#2020", "Home", 2, "UP", ["police"], True, "p", "5 / 1", None, "Budget", "x", "Rules of pay", "{}"), ("2#2#3#2020", "Home", 2, "UP", ["land"], False, "p", "5 / 2", None, "", "x", "Rules of pay", "{}")]
    docs = spark.createDataFrame(rows, "source_id string, department string, department_id int, jurisdiction_code string, topics array<string>, provenance_ok boolean, provider string, go_number string, go_date string, section string, category string, subject string, metadata string")
    assert filters.scope(docs, {}).count() == 1 and filters.scope(docs, {"official": False}).count() == 2
    assert filters.scope(docs, {"official": False, "departments": ["Home"], "topics": ["land"], "words": "rules pay", "number_prefix": "5/"}).count() == 1
    with pytest.raises(ValueError):
        filters.scope(docs, {"colour": "red"})


def test_reflow(spark):
    two = "\n".join(f"{f'left line {k:02d} of text':<40}right line {k:02d} of text" for k in range(10))
    rows = [("a", n, two) for n in (1, 2)] + [("a", 3, "plain"), ("b", 1, two), ("b", 2, two), ("c", 1, two), *[("c", n, "plain") for n in (2, 3)], ("d", 1, None)]
    got = {(r["d"], r["n"]): r["text"] for r in layout.reflow(spark.createDataFrame(rows, "d string, n int, text string"), "d", "text").collect()}
    assert got["a", 1] == got["a", 2] != two and got["a", 1].startswith("left line 00 of text\nleft line 01") and got["a", 3] == "plain"
    assert got["b", 1] == two and got["c", 1] == two and got["d", 1] is None
    # lines across the gutter stay whole
    wide = two + "\n" + "one line that goes across the whole of the page and the gutter"
    assert each(spark, layout.one_column, [wide])[0].split("\n")[10].endswith("the gutter")


def test_gates_without_a_query(spark):
    df = spark.createDataFrame([("a", None), ("b", "a")], "source_id string, duplicate_of string")
    assert [r["source_id"] for r in df.where(filters.not_duplicates()).collect()] == ["a"]
    texts = ["see https://up.gov.in/a.pdf and https://example.org/b now", "http://x.nic.in/1 https://gov.in.evil.com/2", "no link", "https://gov.in", None]
    assert each(spark, filters.public_links, texts) == ["see https://up.gov.in/a.pdf and now", "http://x.nic.in/1", "no link", "https://gov.in", None]
    rows = [(True, "native", True, "conflict"), (False, "ocr", True, "ocr_only_unverified"), (False, "ocr", False, "variants_agree"), (False, "native", True, "native_primary"), (False, "native", False, "unverified"), (None, None, None, "unverified")]
    got = spark.createDataFrame(rows, "c boolean, v string, k boolean, want string").select("want", P.verification_status(F.col("c"), F.col("v"), F.col("k")).alias("s")).collect()
    assert all(r["s"] == r["want"] for r in got)
    a, b = "x" * 50 + "abc" + "y" * 20, "x" * 50 + "aZc" + "y" * 18
    two = spark.createDataFrame([(a, b)], "a string, b string").select(duplicates.changed_ranges(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert [tuple(x) for x in two] == [(51, 52), (71, 73)]

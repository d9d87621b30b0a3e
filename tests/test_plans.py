import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lekhaspark.functions import text as T
from lekhaspark.operators import ranking, state
from lekhaspark.plans import ORACLES, QUERIES
from lekhaspark.sources import files
from lekhaspark.streaming import ledgers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert plain(got) == plain(want)


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.numeric_tokens, "नियम २१ वर्ष २०२०") == ["21", "2020"]
    assert one(spark, T.numeric_tokens, "Rule 5, rule 5.") == ["5"]
    dates = {"26/09/2026": "2026-09-26", "5/1/2024": "2024-01-05", "31/02/2024": "None", "2024/01/05": "None"}
    assert {k: str(one(spark, T.iso_date, k)) for k in dates} == dates
    keys = {"42/2026/77-1002-2-2021/001-467": "42/2026", "१/२०१९/४/१": "1/2019", "160/दस-2012-216/79": "160/2012", "G-2-160/दस-2012": None}
    assert {k: one(spark, T.go_key, k) for k in keys} == keys
    assert one(spark, T.order_key, "1342/नौ-4-2020", "2020-08-18") == one(spark, T.order_key, "१३४२/नौ-4-2020", "18/08/2020")
    assert one(spark, T.normalize_space, " a\r\n\n\n\nb \t c ") == "a\n\nb c"
    assert one(spark, T.text_quality, "नियम " * 5) == 100


def test_neighbours(spark):
    pages = spark.createDataFrame([("d", p) for p in range(1, 30)], "doc string, page int")
    seeds = spark.createDataFrame([("d", p, i) for i, p in enumerate((19, 18, 20, 15))], "doc string, page int, rank int")
    got = {(r["page"], r["anchor_page"]) for r in ranking.neighbours(seeds, pages, 1, 3).collect()}
    assert got == {(17, 18), (21, 20), (14, 15)}


def test_authority(spark):
    rows = [("a", 0.80, "A", False, False), ("b", 0.84, "B", False, False), ("c", 0.90, "A", False, True), ("d", 0.85, "C", False, False), ("e", 0.80, "B", False, False)]
    df = spark.createDataFrame(rows, "id string, p double, tier string, sure boolean, old boolean")
    s = {r[0]: r[1] for r in df.select("id", ranking.authority_score(*map(F.col, ("p", "tier", "sure", "old")))).collect()}
    assert s["a"] > s["b"] and s["c"] < s["a"] and s["d"] < s["e"]


def test_state_and_files(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, state.upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, state.insert_new(a, b, ["k"], ["v"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    log = str(tmp_path / "log")
    files.append_ledger(spark.createDataFrame([("s", 1, "retry"), ("s", 2, "stored")], "id string, at int, state string"), log)
    stream = files.stream_jsonl(spark, log, spark.read.json(log).schema)
    ledgers.keep_latest(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["id"], ["at"], "state").awaitTermination()
    got = ledgers.current(spark.read.parquet(str(tmp_path / "t")), ["id"], ["at"], "state").collect()
    assert [(r["id"], r["state"], r["entries"]) for r in got] == [("s", "stored", 2)]
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "at": 1}\n\n{broken\n')
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), stream.schema, strict=False).count() == 1


def tied_lines(spark, tmp_path, rows):
    """A folder with these lines (order, line, supplier, price), in several files, and the SQL engine on it."""
    d = str(tmp_path)
    for n, r in enumerate(rows):
        frame = spark.createDataFrame([r], "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double")
        frame.coalesce(1).write.mode("append").parquet(f"{d}/lineitem.parquet")
    os.symlink(f"{SF}/pages.parquet", f"{d}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{d}/lineitem.parquet/*.parquet'")
    return d, c


def test_best_page_of_equal_prices(spark, tmp_path):
    rows = [(1, 5, 1, 9.0), (1, 2, 2, 9.0), (1, 7, 3, 9.0), (1, 1, 4, 3.0), (2, 3, 1, None), (3, 4, 1, None), (3, 6, 1, 1.0)]
    d, c = tied_lines(spark, tmp_path, rows)
    got = sorted(map(tuple, QUERIES["group_pages_by_order"](spark, d).collect()))
    assert got == [(1, 2, -3.0, 4), (2, None, None, 1), (3, 6, -1.0, 2)]
    assert got == sorted(c.execute(ORACLES["group_pages_by_order"]).fetchall())


def test_equal_prices_of_one_line(spark, tmp_path):
    """Lines that share order, number and price are on different pages: the supplier decides, whatever the order of the files."""
    rows = [(o, 1, s, 9.0) for o, suppliers in ((1, (6, 5, 7)), (2, (7, 6, 5)), (3, (5, 7, 6))) for s in suppliers] + [(1, 2, 4, 1.0)]
    d, c = tied_lines(spark, tmp_path, rows)
    for name in ("rerank_pool", "alternate_variants"):
        got = QUERIES[name](spark, d)
        assert sorted(map(tuple, got.collect())) == sorted(c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]}) x").fetchall()), name
    got = QUERIES["rerank_pool"](spark, d).where("rank <= 3").orderBy("query", "rank").collect()
    assert [(r["query"], r["page"]) for r in got] == [(q, p) for q in (1, 2, 3) for p in (1, 2, 3)]


def test_short_stems_of_patterns(spark, tmp_path):
    """A text without a word of four letters leaves a pattern whose stem has two: too short for a search by meaning."""
    d = str(tmp_path)
    spark.createDataFrame([(3, "solar pumps"), (18, ""), (33, None)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0,)], "n_nationkey int").write.parquet(f"{d}/nation.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    got = QUERIES["parsed_questions"](spark, d)
    assert sorted((r["query"], r["patterns"], r["similar"]) for r in got.collect()) == [(3, "zysolar*", "zysolar"), (18, "zy*", None), (33, "zy*", None)]
    assert sorted(c.sql(ORACLES["parsed_questions"]).project('query, patterns, "similar"').fetchall()) == [(3, "zysolar*", "zysolar"), (18, "zy*", None), (33, "zy*", None)]

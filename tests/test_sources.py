import json

from pyspark.sql import functions as F

from lekhaspark.sources import files
from lekhaspark.streaming import ledgers


def test_trees_arrays_and_cut_off_logs(spark, tmp_path):
    for k in ("a", "b"):
        (tmp_path / "tree" / k).mkdir(parents=True)
        (tmp_path / "tree" / k / "metadata.json").write_text(json.dumps({"id": k}, indent=1))
    (tmp_path / "tree" / "c").mkdir()
    schema = spark.createDataFrame([], "id string").schema
    assert sorted((r["id"], r["folder"]) for r in files.read_metadata_tree(spark, str(tmp_path / "tree"), schema).collect()) == [("a", "a"), ("b", "b")]
    (tmp_path / "plain.json").write_text('[{"id": "x"},\n {"id": "y"}]')
    (tmp_path / "wrapped.json").write_text('{"rows": [{"id": "x"}]}')
    assert sorted(r["id"] for r in files.read_array(spark, str(tmp_path / "plain.json"), schema).collect()) == ["x", "y"]
    wrapped = spark.createDataFrame([], "rows array<struct<id: string>>").schema
    assert [r["id"] for r in files.read_array(spark, str(tmp_path / "wrapped.json"), wrapped, "rows").collect()] == ["x"]
    (tmp_path / "log.jsonl").write_text('{"id": "x"}\n\n{"id": "y"}\n{"id": "z')
    assert sorted(r["id"] for r in files.whole_lines(spark, str(tmp_path / "log.jsonl"), schema).collect()) == ["x", "y"]


def test_front_matter(spark, tmp_path):
    (tmp_path / "good.md").write_text('---\ntitle: "Solar pumps"\nboost: 2\ntriggers:\n- solar pump\n- kisan: a\npages:\n  - 1#2#3#2020 p.4\n  - core-1 p.12\n---\n# Body\ntext\n')
    (tmp_path / "bad.md").write_text("---\n- lonely\ntitle: x\n---\nbody")
    (tmp_path / "none.md").write_text("just text")
    rows = {r["file"].split("/")[-1]: r for r in files.read_front_matter(spark, str(tmp_path)).withColumn("refs", files.page_references(F.col("entries"))).collect()}
    good = rows["good.md"]
    assert [tuple(e) for e in good["entries"]][:4] == [("title", "Solar pumps"), ("boost", "2"), ("triggers", "solar pump"), ("triggers", "kisan: a")]
    assert [tuple(x) for x in good["refs"]] == [("1#2#3#2020", 4), ("core-1", 12)] and good["body"] == "# Body\ntext\n" and good["problem"] is None
    assert rows["bad.md"]["problem"] == "cannot read: - lonely" and [tuple(e) for e in rows["bad.md"]["entries"]] == [("title", "x")]
    assert rows["none.md"]["problem"] == "no front matter" and rows["none.md"]["body"] == "just text"


def test_a_replayed_batch_counts_once(spark, tmp_path):
    log, table = str(tmp_path / "log"), str(tmp_path / "t")
    rows = [("s", 1, "retry"), ("s", 2, "stored"), ("s", 2, "stored"), ("u", 1, "new")]
    files.append_ledger(spark.createDataFrame(rows, "id string, at int, state string"), log)
    schema = spark.read.json(log).schema
    for checkpoint in ("c1", "c2"):  # a lost checkpoint: the first batch is read again
        ledgers.keep_latest(files.stream_jsonl(spark, log, schema), table, str(tmp_path / checkpoint), ["id"], ["at"], "state").awaitTermination()
    got = {r["id"]: (r["state"], r["entries"]) for r in ledgers.current(spark.read.parquet(table), ["id"], ["at"], "state").collect()}
    assert got == {"s": ("stored", 3), "u": ("new", 1)}


def test_tail(spark, tmp_path):
    from lekhaspark.sources.tail import Range, last_line_end, lines_of, tail

    path = tmp_path / "ledger.jsonl"

    def run():
        query = tail(spark, str(path), 16).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["offset"], r["line"]) for r in spark.read.schema("line string, offset long").parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []

    run()
    path.write_bytes('{"a": 1}\r\n\nनियम पंक्ति\n{"cut'.encode())
    first = run()
    assert first == [(0, '{"a": 1}'), (10, ""), (11, "नियम पंक्ति")]
    with path.open("ab") as f:
        f.write(b'": 2}\n' + b"x" * 100 + b"\nlast")
    again = run()
    start = len('{"a": 1}\r\n\nनियम पंक्ति\n'.encode())
    assert again == [*first, (start, '{"cut": 2}'), (start + 11, "x" * 100)]
    assert run() == again and last_line_end(str(path)) == start + 112 and last_line_end(str(tmp_path / "none"), 7) == 7
    # however the bytes are cut, every line is in one range
    end = last_line_end(str(path))
    for size in (1, 3, 10, 64, 1000):
        cuts = [*range(0, end, size), end]
        assert [x for a, b in zip(cuts, cuts[1:]) for x in lines_of(str(path), Range(a, b, a == 0))] == [(line, at) for at, line in again]

"""Sources and sinks: JSON Lines, metadata trees, wrapped datasets, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped, malformed ones fail or are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_metadata_tree(spark: SparkSession, root: str, schema: StructType, name: str = "metadata.json") -> DataFrame:
    """One document for each sub-folder that holds `name`; unreadable ones are dropped."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/*/{name}")
    return rows.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_wrapped(spark: SparkSession, path: str, schema: StructType, field: str) -> DataFrame:
    """The elements of an array under `field` of one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline(field))


def write_jsonl(df: DataFrame, path: str, by: str) -> None:
    """Sorted by id over the part files."""
    df.orderBy(by).write.mode("overwrite").json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def stream_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New files of a growing folder."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_array(spark: SparkSession, path: str, schema: StructType, field: str | None = None) -> DataFrame:
    """The elements of a JSON array: the whole document, or the array under `field`."""
    return read_wrapped(spark, path, schema, field) if field else spark.read.schema(schema).option("multiLine", True).json(path)


def whole_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Entries of a log that may be cut off in its last line: what is no whole object is left for the next reading."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.col("value").rlike(r"\}\s*$").alias("whole"))
    return parsed.where("whole and r is not null").select("r.*")


def front_matter(text):
    """struct(entries: array<struct<key, value>>, body, problem) of a Markdown text with front matter between two lines of three
    dashes: `key: value`, or `key:` and `- item` lines, which give an entry each. problem names what cannot be read."""
    line = "string"
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    known = text.rlike(r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)")
    entry = "array<struct<key: string, value: string>>"
    start = F.struct(F.lit(None).cast(line).alias("key"), F.array().cast(entry).alias("entries"), F.lit(None).cast(line).alias("problem"))
    unquoted = lambda v: F.regexp_replace(F.trim(v), r"^([\"'])(.*)\1$", "$2")

    def add(state, x):
        named, item = x.rlike(r"^[A-Za-z_][\w-]*:(\s|$)"), x.rlike(r"^\s*-\s+\S")
        key = F.when(named, F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1)).otherwise(state["key"])
        value = unquoted(F.when(named, F.regexp_replace(x, r"^[A-Za-z_][\w-]*:", "")).otherwise(F.regexp_replace(x, r"^\s*-\s+", "")))
        blank = F.trim(x) == ""
        good = blank | named | (item & state["key"].isNotNull())
        new = F.when(~blank & good & (value != ""), F.array(F.struct(key.alias("key"), value.alias("value")))).otherwise(F.array().cast(entry))
        return F.struct(key.alias("key"), F.concat(state["entries"], new).alias("entries"), F.coalesce(state["problem"], F.when(~good, F.concat(F.lit("cannot read: "), x))).alias("problem"))

    parsed = F.aggregate(F.split(head, r"\r?\n"), start, add)
    body = F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    return F.when(known, F.struct(parsed["entries"].alias("entries"), body.alias("body"), parsed["problem"].alias("problem"))).otherwise(
        F.struct(F.array().cast(entry).alias("entries"), text.alias("body"), F.lit("no front matter").alias("problem"))
    )


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """file, entries, body and problem of every Markdown file."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), front_matter(F.col("value")).alias("m"))
    return texts.select("file", "m.*")


def page_references(entries):
    """array<struct<source_id, page>> of the entries of the form `source p.N`."""
    items = F.filter(entries, lambda e: e["value"].rlike(r"\sp\.\d+$"))
    return F.transform(items, lambda e: F.struct(F.regexp_extract(e["value"], r"^(.*?)\s+p\.\d+$", 1).alias("source_id"), F.regexp_extract(e["value"], r"p\.(\d+)$", 1).cast("int").alias("page")))

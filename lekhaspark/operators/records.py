"""JSON fields, replies of models, attribute merges, run logs, probes, storage keys and recent-first lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def json_has(metadata: Column, path: str, value: Column, kind: str = "int") -> Column:
    """Whether the array at a path contains the value; false where there is no array."""
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(metadata, path), f"array<{kind}>"), value), F.lit(False))


def json_merge(a: Column, b: Column) -> Column:
    """One JSON object of two flat ones; equal keys have the second's value."""
    left, right = (F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>")) for x in (a, b))
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, right)))))


def json_texts(metadata: Column, path: str) -> Column:
    """The array at a path as array<string>, empty where there is none."""
    return F.coalesce(F.from_json(F.get_json_object(metadata, path), "array<string>"), F.array().cast("array<string>"))


def merge_attributes(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of the updates that name them; parallel arrays of updates are unnested by `unnest` first."""
    named = updates.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    met = rows.join(named, key, "left")
    return met.select(*[F.when(F.col("_hit"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def unnest(rows: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays as rows; shorter ones are filled with null."""
    return rows.select(F.inline(F.arrays_zip(*arrays)))


def model_reply(reply: Column, schema: str) -> Column:
    """The first JSON object of a model's reply, after its thoughts, as a struct; null where there is none."""
    text = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def clamp(c: Column, allowed: list[str], aliases: dict[str, str], otherwise: str | None = None) -> Column:
    """A label in lower case with dashes, after aliases, if it is an allowed one."""
    label = F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-")
    for k, v in aliases.items():
        label = F.when(label == k, v).otherwise(label)
    return F.when(label.isin(allowed), label).otherwise(F.lit(otherwise))


def recent_first(rows: DataFrame, when: str, limit: int, most: int = 500) -> DataFrame:
    """The newest rows, as many as asked for within 1 and `most`."""
    return rows.orderBy(F.desc(when), *[c for c in rows.columns if c != when][:1]).limit(max(1, min(limit, most)))


def conversation_list(rows: DataFrame, archived: bool = False) -> DataFrame:
    """Conversations of the list or of the archive, newest first; pinned ones stand first in the list only."""
    pinned = [] if archived else [F.desc("pinned")]
    return rows.where(F.col("archived") == archived).orderBy(*pinned, F.desc("updated_at"), "conv_id")


def set_feedback(messages: DataFrame, feedback: DataFrame, asked: DataFrame) -> DataFrame:
    """The feedback table after requests (user_id, message_id, rating, null clears): the user's own assistant messages only."""
    own = asked.join(messages.where("role = 'assistant'").select("message_id", "user_id"), ["message_id", "user_id"], "left_semi")
    kept = feedback.join(own.select("message_id", "user_id"), ["message_id", "user_id"], "left_anti").select("user_id", "message_id", "rating")
    return kept.unionByName(own.where("rating is not null").select("user_id", "message_id", "rating"))


def replace_table(rows: DataFrame, path: str) -> None:
    """A derived table as a whole: what stood there goes in the same write."""
    rows.write.mode("overwrite").parquet(path)


def logged_run(rows: DataFrame, path: str, log: str, name: str) -> dict:
    """Writes rows, and one line on the run (status, rows, message) to the log, whether it ends well or not."""
    seen = Observation(f"run {name}")
    spark, out = rows.sparkSession, {"run": name, "status": "completed", "rows": 0, "message": ""}
    try:
        rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
        out["rows"] = seen.get["n"]
    except Exception as error:
        out |= {"status": "failed", "message": str(error)[:500]}
        raise
    finally:
        spark.createDataFrame([out], "run string, status string, rows long, message string").write.mode("append").json(log)
    return out


def probe_grid(known: DataFrame, radius: int = 3) -> DataFrame:
    """known (source_id number#department#section#year) -> ids around each that are not known themselves."""
    p = F.split("source_id", "#")
    near = known.select(F.explode(F.sequence(p[0].cast("long") - radius, p[0].cast("long") + radius)).alias("n"), *(p[k].alias(f"p{k}") for k in (1, 2, 3)))
    ids = near.where("n > 0").select(F.concat_ws("#", F.col("n").cast("string"), "p1", "p2", "p3").alias("source_id")).distinct()
    return ids.join(known, "source_id", "left_anti")


def probe_class(status: Column, kind: Column, size: Column) -> Column:
    """What a probe found: pdf, html, empty-html or error."""
    return F.when(status != 200, "error").when(kind.startswith("application/pdf"), "pdf").when(size < 2000, "empty-html").otherwise("html")


def verified_copy(bucket: Column, expected_bucket: str, sha256: Column, expected: Column, *file_ids: Column) -> Column:
    """A stored copy counts when bucket and hash are right and every file id is there."""
    ok = (bucket == expected_bucket) & (F.lower(sha256) == F.lower(expected))
    for f in file_ids:
        ok = ok & (F.coalesce(f, F.lit("")) != "")
    return F.coalesce(ok, F.lit(False))


def object_key(source_id: Column, name: Column) -> Column:
    """Archive key of a file: # as -, only letters, digits, dot, dash and underscore; null for anything else."""
    key = F.concat(F.translate(source_id, "#", "-"), F.lit("/"), name)
    return F.when(key.rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$") & ~key.contains(".."), key)


def place_codes(names: DataFrame, places: DataFrame) -> DataFrame:
    """names (name) with the code of the place (code, name, aliases array) whose key it has; null where none or several have."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")
    keys = places.select("code", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    keys = keys.select(key(F.col("n")).alias("_k"), "code").groupBy("_k").agg(F.min("code").alias("code"), F.max("code").alias("_hi")).where("code = _hi").drop("_hi")
    return names.withColumn("_k", key(F.col("name"))).join(keys, "_k", "left").drop("_k")


def portal_record(url: Column, claimed: Column, hosts: list[str], path: str, canonical: str) -> Column:
    """struct(source_id, url, problem) of a listed link: hosts with or without www and in any case are one; the id is what the
    link's id1 encodes, and must equal a claimed one."""
    host = F.regexp_replace(F.lower(F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    right = host.isin(hosts) & (F.lower(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))) == path.lower())
    encoded = F.coalesce(F.parse_url(url, F.lit("QUERY"), F.lit("id1")), F.lit(""))
    decoded = F.decode(F.try_to_binary(F.url_decode(encoded), F.lit("base64")), "UTF-8")
    found = F.when(decoded.rlike(r"^\d+#\d+#\d+#\d{4}$"), decoded)
    problem = F.when(~right, "not the official endpoint").when(found.isNull(), "no order identifier").when(claimed.isNotNull() & (claimed != found), "id does not match the link")
    ok = problem.isNull()
    return F.struct(F.when(ok, found).alias("source_id"), F.when(ok, F.concat(F.lit(canonical + "?"), F.parse_url(url, F.lit("QUERY")))).alias("url"), problem.alias("problem"))

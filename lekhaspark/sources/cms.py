"""Answers of a content system's JSON interface: listings of posts, and for each of their files the attachments with their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of an answer that are read; fields of attachments have names of their own, so they stay JSON until they are looked at.
LISTING = "posts array<struct<ID: bigint, post_title: string, acf_data: struct<date: string, file: array<struct<file: array<bigint>>>>>>, total_pages int"
FILE = "posts struct<acf_data: map<string, string>>"


def slashed_date(c: Column) -> Column:
    """"21/09/2026" as "2026-09-21", null for anything else."""
    part = lambda k: F.regexp_extract(F.trim(c), r"^(\d{2})/(\d{2})/(\d{4})$", k)
    return F.when(part(1) != "", F.concat_ws("-", part(3), part(2), part(1)))


def file_language(key: Column, languages: Column) -> Column:
    """hi, en, mixed or unknown, by the name of the field, else by the one language that the file states."""
    only = F.when(F.size(languages) == 1, F.lower(languages[0]))
    hindi, english = (key == "pdf_hindi") | F.coalesce(only.contains("hindi"), F.lit(False)), (key == "pdf_english") | F.coalesce(only.contains("english"), F.lit(False))
    return F.when(hindi, "hi").when(english, "en").when(key == "pdf_both", "mixed").otherwise("unknown")


def attachments_of(files: DataFrame) -> DataFrame:
    """files (site, file_id, body) -> (site, file_id, files: array<struct<key, language, date, url>>): the fields of a file that are attachments, in the order of their names."""
    acf = F.from_json("body", FILE)["posts"]["acf_data"]
    held = files.select("site", "file_id", acf.alias("acf"))
    languages = F.coalesce(F.from_json(F.try_element_at("acf", F.lit("language")), "array<string>"), F.array().cast("array<string>"))
    day = slashed_date(F.regexp_replace(F.coalesce(F.try_element_at("acf", F.lit("file_date")), F.lit("")), '^"|"$', ""))
    held = held.select("site", "file_id", "acf", languages.alias("languages"), day.alias("day"))
    url = lambda e: F.get_json_object(e["value"], "$.url")
    entries = F.filter(F.array_sort(F.map_entries("acf")), lambda e: F.coalesce(e["value"].startswith("{") & url(e).isNotNull(), F.lit(False)))
    each = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), file_language(e["key"], F.col("languages")).alias("language"), F.col("day").alias("date"), url(e).alias("url")))
    return held.select("site", "file_id", each.alias("files"))


def cms_posts(answers: DataFrame, files: DataFrame) -> DataFrame:
    """answers (place, site, body: a page of a listing), files (site, file_id, body) -> (place, site, post_id, title, date, files), as `listings.attachments` takes them: one row for each post that a listing
    shows, with the attachments of all its files in their order. place is that of the answer and that of the post in it, so that no task sorts all posts of a site.
    Answers that are no JSON have no posts."""
    # a stated number of tasks, which Spark does not merge: lists are more than the bytes tell
    n = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = answers.select("site", "place", F.posexplode(F.from_json("body", LISTING)["posts"]).alias("at", "p"))
    ids = F.flatten(F.transform("p.acf_data.file", lambda f: F.coalesce(f["file"], F.array().cast("array<bigint>"))))
    posts = posts.select(F.struct("place", "at").alias("place"), "site", F.col("p.ID").alias("post_id"), F.col("p.post_title").alias("title"), slashed_date(F.col("p.acf_data.date")).alias("date"), ids.alias("ids"))
    each = posts.select("place", "site", F.posexplode_outer("ids").alias("n", "file_id")).where("file_id is not null").join(attachments_of(files), ["site", "file_id"])
    held = each.repartition(n, "place", "site").groupBy("place", "site").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "files"))), lambda x: x["files"])).alias("files"))
    met = posts.drop("ids").join(held, ["place", "site"], "left")
    none = F.array().cast("array<struct<key: string, language: string, date: string, url: string>>")
    return met.select("place", "site", "post_id", "title", "date", F.coalesce("files", none).alias("files"))

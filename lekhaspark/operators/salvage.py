"""What can be kept of an answer that failed its checks: sentences that stand on their pages, and citations that were missing.

Answers are cut into sentences within lines; a sentence without a citation leans on the next one of its line. Both operators are joins of
these sentences with the pages of the same answer, so the work is spread by answer; nothing is invented or rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digit_groups
from .answers import CITATION, LIST_NUMBER, is_held, judged, page_texts

LEAST_KEPT = 0.3
LEAST_WORDS = 3
LEAST_SHARED = 3
#: Stands where a sentence and its citations are joined; no text has it.
JOIN = "\ue000"

# Marks that must not be shown, and beginnings that lean on a sentence before.
PLACEHOLDER = r"(?i)\[+UNVERIFIED_NUMERIC\]+|<+UNVERIFIED_NUMERIC>+|\bUNVERIFIED_NUMERIC\b"
DEPENDENT = r"(?i)^(?:this|that|these|those|it)\s+(?:is|are|was|were|will\s+be|would\s+be)\s+(?:also\s+)?(?:followed|continued|then)\b|^(?:after\s+that|thereafter|furthermore|moreover)\b"
BULLETS = r"^\s*(?:[-–—•*]+\s*)+"
_CITED_ONLY = r"(?:\[S\d+\s+p\.\d+\]\s*)+"


def bare(sentence: Column) -> Column:
    return F.regexp_replace(sentence, CITATION, "")


def n_words(sentence: Column) -> Column:
    return F.size(F.regexp_extract_all(bare(sentence), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))


def content_words(text: Column) -> Column:
    """Distinct words of four letters and more, outside citations."""
    return F.array_distinct(F.regexp_extract_all(F.lower(bare(text)), F.lit(r"[\p{L}\p{M}]{4,}"), F.lit(0)))


def sentence_units(answers: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each sentence: key, unit, line (the sentence), at_line, cited, digits. What is only citations belongs to the sentence
    before it; a sentence without citations has those of the next cited one on its line. A list number is no digit of it."""
    joined = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"\n+\s*(?:[-–—•*]+\s*)?(?={_CITED_ONLY}[.,;।]?\s*(?:\n|$))", " ")
    joined = F.regexp_replace(joined, rf"(?<=[.!?।])\s+(?={_CITED_ONLY}(?:[.,;।]?\s*(?:\n|$)|[.!?।]\s))", JOIN)
    parts = F.flatten(F.transform(F.split(joined, "\n+"), lambda x, i: F.transform(F.split(x, r"(?<=[.!?।])\s+"), lambda p: F.struct(i.alias("at"), F.trim(F.replace(p, F.lit(JOIN), F.lit(" "))).alias("s")))))

    def citations(s: Column) -> Column:
        labels, pages = (F.regexp_extract_all(s, F.lit(CITATION), F.lit(k)) for k in (1, 2))
        return F.array_distinct(F.zip_with(labels, pages, lambda a, p: F.struct(a.alias("label"), p.try_cast("int").alias("page"))))

    own = F.transform(F.filter(parts, lambda p: p["s"] != ""), lambda p: F.struct(p["at"].alias("at"), p["s"].alias("s"), citations(p["s"]).alias("c")))
    each = answers.select(key, own.alias("all")).select(key, "all", F.posexplode_outer("all").alias("unit", "u")).where("unit is not null")
    later = F.filter(F.slice("all", F.col("unit") + 2, F.size("all")), lambda p: (p["at"] == F.col("u.at")) & (F.size(p["c"]) > 0))
    cited = F.when(F.size("u.c") > 0, F.col("u.c")).otherwise(F.coalesce(F.get(later, F.lit(0))["c"], F.slice("u.c", 1, 0)))
    return each.select(key, "unit", F.col("u.s").alias("line"), F.col("u.at").alias("at_line"), cited.alias("cited"), digit_groups(bare(F.regexp_replace("u.s", LIST_NUMBER, ""))).alias("digits"))


def salvage(answers: DataFrame, key: str, text: str, evidence: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(key, kept, sentences, salvaged) of every answer: the sentences that cite a page of the evidence, whose numbers stand on a cited page that prints
    them reliably, that have LEAST_WORDS words, hold no placeholder and do not lean on a sentence that may be gone. Several are a list.
    Where less than LEAST_KEPT of the sentences with words can be kept, nothing is (an empty text): a fragment misleads.

    evidence and named are those of `answers.numeric_issues`."""
    units = judged(sentence_units(answers, key, text), key, evidence, named)
    clean = F.trim(F.regexp_replace(F.regexp_replace("line", LIST_NUMBER, ""), BULLETS, ""))
    stars = F.regexp_count(clean, F.lit(r"\*\*"))
    clean = F.when(stars % 2 == 1, F.replace(clean, F.lit("**"), F.lit(""))).otherwise(clean)
    shown = ~F.col("line").rlike(PLACEHOLDER)
    met = units.select(key, "unit", "line", F.col("issue").isNull().alias("_good"), F.exists("cited", is_held).alias("_valid")).withColumn("clean", clean)
    keep = shown & F.col("_good") & F.col("_valid") & (n_words(F.col("clean")) >= LEAST_WORDS) & ~F.col("clean").rlike(DEPENDENT)
    worded = shown & (n_words(F.regexp_replace("line", LIST_NUMBER, "")) >= LEAST_WORDS)
    found = met.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.coalesce(keep, F.lit(False)), F.struct("unit", "clean")))).alias("_kept"), F.count_if(worded).alias("sentences"))
    lines = F.transform("_kept", lambda x: x["clean"])
    enough = (F.size("_kept") > 0) & (F.size("_kept") >= F.ceil(F.col("sentences") * LEAST_KEPT))
    as_text = F.when(F.size("_kept") == 1, lines[0]).otherwise(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("• "), x)), "\n"))
    kept = found.select(key, F.size("_kept").alias("kept"), "sentences", F.when(enough, as_text).otherwise("").alias("salvaged"))
    zero = F.lit(0)
    return answers.select(key).join(kept, key, "left").select(key, F.coalesce("kept", zero).alias("kept"), F.coalesce("sentences", zero.cast("long")).alias("sentences"), F.coalesce("salvaged", F.lit("")).alias("salvaged"))


def add_citations(answers: DataFrame, key: str, text: str, evidence: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(key, answer, added): sentences whose numbers are cited to no page or to the wrong one get the page that prints all of them
    reliably and shares the most words with the sentence, LEAST_SHARED at least; of equals the first by label and page. The citation stands before the
    closing mark. Other sentences stay as they are."""
    units = sentence_units(answers, key, text)
    if named is not None:
        units = units.join(named.select(key, F.col("numbers").alias("_named")), key, "left")
        units = units.withColumn("digits", F.array_except("digits", F.coalesce("_named", F.array().cast("array<string>")))).drop("_named")
    units = judged(units, key, evidence, on_page=content_words(F.array_join(page_texts(), " ")))
    open_ = units.select(key, "unit", "line", "digits", F.when(F.col("issue").isin("uncited", "unsupported"), F.col("pages")).alias("pages"), content_words(F.col("line")).alias("words"))

    def fits(p: Column) -> Column:
        holding = F.size(F.filter(p["groups"], lambda g: F.size(F.array_except("digits", g)) == 0))
        return (F.size(F.array_except("digits", F.flatten(p["groups"]))) == 0) & (~p["risky"] | (holding >= 2)) & (F.size(F.array_intersect("words", p["on_page"])) >= LEAST_SHARED)

    # of equals the least comes first
    ranked = F.transform(F.filter("pages", fits), lambda p: F.struct((-F.size(F.array_intersect("words", p["on_page"]))).alias("shared"), F.length(p["label"]).alias("n"), p["label"].alias("label"), p["page"].alias("page")))
    best = F.when(F.size("pages") > 0, F.array_min(ranked))
    first = open_.select(key, "unit", "line", best.alias("best"))
    citation = F.concat(F.lit(" ["), "best.label", F.lit(" p."), "best.page", F.lit("]"))
    ended = F.regexp_extract("line", r"([.।!?])\s*$", 1)
    fixed = F.when(ended != "", F.concat(F.regexp_replace("line", r"\s*[.।!?]\s*$", ""), citation, ended)).otherwise(F.concat("line", citation))
    changes = first.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("unit", "line", fixed.alias("fixed"))))).alias("changes"))
    met = answers.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(changes, key, "left")
    # sentences are put in from the first on, each searched for after the one before
    start = F.struct(F.lit("").alias("done"), F.col("_text").alias("rest"), F.lit(0).alias("added"))

    def put(state: Column, c: Column) -> Column:
        at = F.instr(state["rest"], c["line"])
        here = F.struct(F.concat(state["done"], F.substr(state["rest"], F.lit(1), at - 1), c["fixed"]).alias("done"), F.substr(state["rest"], at + F.length(c["line"]), F.length(state["rest"])).alias("rest"), (state["added"] + 1).alias("added"))
        return F.when(at > 0, here).otherwise(state)

    out = F.aggregate(F.coalesce("changes", F.slice(F.array(F.struct(F.lit(0).alias("unit"), F.lit("").alias("line"), F.lit("").alias("fixed"))), 1, 0)), start, put)
    return met.select(key, out.alias("o")).select(key, F.concat("o.done", "o.rest").alias("answer"), F.col("o.added").alias("added"))

"""Checks of generated answers against the pages they cite, as joins and array work."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import digit_groups

# Citations, list numbers, and words by which a sentence itself asks for a check.
CITATION = r"\[(S\d+)\s+p\.(\d+)\]"
LIST_NUMBER = r"^\s*(?:[-–—•*]\s*)?[0-9०-९]{1,2}[.)]\s*"
CAUTION = (
    r"(?iu)\b(?:unverified|not (?:been )?verified|(?:requires?|needs?) (?:verification|checking)|(?:should|must) be (?:verified|checked)|"
    r"verify (?:(?:it|this|these|them|the (?:value|number|date|figure|amount)) )?against|check(?:ed)? against|(?:original|cited) (?:source )?page|source page)\b|"
    r"(?:असत्यापित|सत्यापित नहीं|सत्यापन आवश्यक|सत्यापन की आवश्यकता|मूल पृष्ठ|मूल पेज|मूल आदेश से (?:जाँच|जांच|मिलान|पुष्टि)|पुष्टि (?:करें|आवश्यक))"
)


def masked_numbers(c: Column, risky: Column) -> Column:
    """A text of a risky page without its numbers, so that none can be quoted."""
    less = F.regexp_replace(F.regexp_replace(c, r"[0-9०-९]+(?:[.,:/-][0-9०-९]+)*(?:\s*%)?", ""), r"\s+%", "")
    less = F.regexp_replace(F.regexp_replace(less, r"[ \t]{2,}", " "), r"\n[ \t]+", "\n")
    return F.when(risky, F.regexp_replace(less, r"^\s+|\s+$", "")).otherwise(c)


def claim_units(answers: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line with text: key, unit, line, cited (label, page), digits outside citations and list numbers.
    A line of citations only belongs to the line before it."""
    joined = F.regexp_replace(F.col(text), r"\n\s*(?=(?:\[S\d+\s+p\.\d+\][\s.,;]*)+(?:\n|$))", " ")
    lines = answers.select(key, F.posexplode_outer(F.split(joined, "\n")).alias("unit", "line")).where("trim(line) <> ''")
    labels, pages = F.regexp_extract_all("line", F.lit(CITATION), F.lit(1)), F.regexp_extract_all("line", F.lit(CITATION), F.lit(2))
    cited = F.array_distinct(F.zip_with(labels, pages, lambda s, p: F.struct(s.alias("label"), p.try_cast("int").alias("page"))))
    bare = F.regexp_replace(F.regexp_replace("line", CITATION, ""), LIST_NUMBER, "")
    return lines.select(key, "unit", "line", cited.alias("cited"), digit_groups(bare).alias("digits"))


def invalid_citations(units: DataFrame, key: str, evidence: DataFrame) -> DataFrame:
    """(key, label, page) cited but not among the evidence."""
    cited = units.select(key, F.explode("cited").alias("c")).select(key, "c.label", "c.page").distinct()
    return cited.join(evidence.select(key, "label", "page"), [key, "label", "page"], "left_anti")


def page_texts() -> Column:
    """The different extractions of a page of the evidence."""
    return F.array_distinct(F.filter("texts", lambda x: F.coalesce(x, F.lit("")) != ""))


def judged(units: DataFrame, key: str, evidence: DataFrame, named: DataFrame | None = None, **more: Column) -> DataFrame:
    """units with `pages` (the evidence of their answer: array of struct(label, page, risky, groups, and `more`), empty without any) and `issue`, as
    numeric_issues has it, else null. The pages of an answer are one row, so a unit meets them in one join by the answer and is read once."""
    if named is not None:
        units = units.join(named.select(key, F.col("numbers").alias("_named")), key, "left")
        units = units.withColumn("digits", F.array_except("digits", F.coalesce("_named", F.array().cast("array<string>")))).drop("_named")
    units = units.withColumn("digits", F.array_distinct("digits"))
    groups = F.transform(page_texts(), lambda x: F.array_distinct(digit_groups(x)))
    page = F.struct("label", "page", "risky", groups.alias("groups"), *[c.alias(n) for n, c in more.items()])
    held = evidence.select(key, page.alias("p")).groupBy(key).agg(F.collect_list("p").alias("pages"))
    met = units.join(held, key, "left")
    met = met.withColumn("pages", F.coalesce("pages", F.array().cast(held.schema["pages"].dataType)))
    named_here = lambda p: F.exists("cited", lambda c: (c["label"] == p["label"]) & (c["page"] == p["page"]))
    holding = lambda p: F.size(F.filter(p["groups"], lambda g: F.size(F.array_except("digits", g)) == 0))
    met = met.withColumn("_met", F.filter("pages", named_here))
    met = met.withColumn("_safe", F.filter("_met", lambda p: ~p["risky"] | (holding(p) >= 2)))
    found = F.flatten(F.transform("_safe", lambda p: F.flatten(p["groups"])))
    issue = F.when(F.size("digits") == 0, None).when(F.size("cited") == 0, "uncited").when(F.col("line").rlike(CAUTION), None)
    issue = issue.when((F.size("_met") > 0) & (F.size("_safe") == 0), "unsafe").when((F.size("_safe") > 0) & (F.size(F.array_except("digits", found)) > 0), "unsupported")
    return met.withColumn("issue", issue).drop("_met", "_safe")


def numeric_issues(units: DataFrame, key: str, evidence: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(key, unit, issue) of lines that state numbers: uncited, unsafe (only risky pages hold them) or unsupported.

    `evidence`: key, label, page, texts (array of the page's extractions), risky. A risky page is safe
    when two different extractions hold all numbers of the line. `named`: key, numbers that are names and no claims."""
    issue = F.when(F.col("issue").isNotNull(), F.array("issue"))
    # the outer form keeps Spark from finding every issue a second time in a filter
    return judged(units, key, evidence, named).select(key, "unit", F.explode_outer(issue).alias("issue")).where("issue is not null")


def is_held(c: Column) -> Column:
    """Whether the cited page is one of `pages`."""
    return F.exists("pages", lambda p: (p["label"] == c["label"]) & (p["page"] == c["page"]))


def validate(answers: DataFrame, key: str, text: str, evidence: DataFrame, named: DataFrame | None = None, placeholder: str = r"<<[A-Z_]+>>") -> DataFrame:
    """(key, issues: sorted codes, ok) of every answer. An answer without words is empty_answer and nothing else; else
    internal_placeholder, missing_citation (evidence was there and none is cited), invalid_citation, and the issues of numbers."""
    words = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CITATION, ""), r"[^\p{L}\p{N}]+", "")
    held = evidence.select(key).distinct().withColumn("_evidence", F.lit(True))
    units = judged(claim_units(answers, key, text), key, evidence, named)
    invalid = F.exists("cited", lambda c: ~F.coalesce(is_held(c), F.lit(False)))
    codes = F.array_compact(F.array(F.when(invalid, F.lit("invalid_citation")), F.col("issue")))
    found = units.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(codes))).alias("_codes"))
    met = answers.select(key, text).join(held, key, "left").join(found, key, "left")
    own = F.array_compact(F.array(F.when(F.col(text).rlike(placeholder), F.lit("internal_placeholder")), F.when(F.col("_evidence") & ~F.col(text).rlike(CITATION), F.lit("missing_citation"))))
    issues = F.when(words == "", F.array(F.lit("empty_answer"))).otherwise(F.array_sort(F.array_union(own, F.coalesce("_codes", F.array().cast("array<string>")))))
    return met.select(key, issues.alias("issues")).withColumn("ok", F.size("issues") == 0)


# How a finished line ends, where a sentence ends, citations after it, list marks.
FINISHED = re.compile(r"[।॥.?!)\]]\s*$")
SENTENCE_ENDS = re.compile(r"[\[\]]|[।॥?!]|\.(?!\d)")
CITATIONS = re.compile(r"\s*(?:\[[^\]]+\]\s*)+[।.]?")
LIST_MARKS = re.compile(r"^[\s\-*•\d.)]+")


def finished_part(line: str) -> str:
    """A line up to its last sentence end outside brackets, with the citations after it; empty when nothing but a list mark is left."""
    if FINISHED.search(line):
        return line
    depth = end = 0
    for m in SENTENCE_ENDS.finditer(line):
        if m[0] in "[]":
            depth = max(0, depth + (1 if m[0] == "[" else -1))
        elif not depth:
            end = m.end()
    cited = CITATIONS.match(line, end) if end else None
    kept = line[: cited.end() if cited else end].rstrip()
    return kept if LIST_MARKS.sub("", kept).strip() else ""


def last_whole_sentence(text: str) -> str:
    """A text that was cut off, back to its last whole sentence, without a lead-in that nothing follows."""
    lines = text.rstrip().split("\n")
    while lines and not (kept := finished_part(lines[-1])).strip():
        lines.pop()
    if lines:
        lines[-1] = kept
    while len(lines) > 1 and lines[-1].rstrip().endswith((":", "：")):
        lines.pop()
        while lines and not lines[-1].strip():
            lines.pop()
    return "\n".join(lines).strip()


@F.pandas_udf(StringType())
def whole_sentences(text: pd.Series) -> pd.Series:
    """Column form of last_whole_sentence; null stays null."""
    return text.map(last_whole_sentence, na_action="ignore")

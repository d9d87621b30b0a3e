"""Records of table rows: result pages of the portal, tables of orders, items of listings with the cells beside their links."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions.grids import grids
from ..functions.text import language, let

LEAST_FIELDS = 4
MOST_LINKS = 4
SHORT_TITLE, LONG_TITLE = 250, 300

# What headers call the fields, the portal's links, labels and notes that say nothing about a document, kinds of orders.
FIELDS = {
    "department": r"(?i)विभाग|Department", "section": r"(?i)अनुभाग|Section", "go_number": r"(?i)संख्या|G\.?\s*O\.?\s*No|Number",
    "go_date": r"(?i)तिथि|दिनांक|Date", "category": r"(?i)श्रेणी|Category", "subject": r"(?i)विषय|Subject",
}
PORTAL, PDF_PAGE = "https://shasanadesh.up.gov.in", "/GO/ViewGOPDF_list_user.aspx"
TOTALS = [r"(?i)कुल\s*प्राप्त\s*अभिलेख\s*[-:：]?\s*([\d,]+)", r"(?i)(?:कुल|Total)[^\d]{0,50}([\d,]{1,9})"]
GENERIC_LABEL = r"(?i)^\W*(?:view|download|click here|open|pdf|here|देखें|डाउनलोड|डाउनलोड करें|क्लिक करें|यहाँ क्लिक करें)\W*$"
SIZE_OR_LANGUAGE = r"(?i)\(?\s*[\d.]+\s*[KM]B\s*\)?|(?:language|भाषा)\s*:\s*(?:hindi|english|हिंदी|हिन्दी|अंग्रेजी)|(?:size|आकार)\s*:?"
TRAILING_DATE = r"(?i)\s+(?:/|dated|dt\.?|दिनांक)\s*(?:(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-]\d{2,4}|\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\.?,?\s+\d{4})\s*$"
STATED_LANGUAGE = r"(?i)(?:language|भाषा)\s*:\s*(hindi|english|हिंदी|हिन्दी|अंग्रेजी)"
NUMBER_IN_TITLE = r"(?:संख्या|सं0|No\.)\s*[:\-–]?\s*([\dA-Za-zऀ-ॿ.]+(?:\s*[/\-–]\s*[\dA-Za-zऀ-ॿ.()]+){2,})"
DATE_END = r"[./, -]\d{4}(?!\d)"
DATE_LINE = "(?m)" + P.DATE_ONLY.replace(r"\s", " ")
REVISION = r"(?i)revision|appellate|petition|appeal|hearing|withdrawal|dismissal"


def rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages (page_id, html) -> (page_id, table, row, header, cells): one row for each row of a table, spans filled in."""
    return pages.select("page_id", F.inline(grids(F.col(html)))).select("page_id", "table", "row", "header", "cells")


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _in_line(text: Column) -> Column:
    """The text of a cell in one line: grids leave no blanks but single spaces and line ends."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def portal_link(href: Column) -> Column:
    """struct(url, source_id) of a link to an order on the portal: its host and page, and an id that decodes to four numbers; else null."""
    url = F.when(href.rlike("(?i)^https?://"), href).otherwise(F.concat(F.lit(PORTAL + "/"), F.regexp_replace(href, r"^(?:\.\./|\./|/)+", "")))

    def read(u: Column) -> Column:
        padded = lambda plain: F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
        decoded = lambda plain: F.try_to_binary(padded(plain), F.lit("base64")).cast("string")
        source = lambda plain: F.when(plain.rlike("^[A-Za-z0-9+/]+=*$"), let(decoded(plain), lambda d: F.when(d.rlike(r"^\d+#\d+#\d+#\d{4}$"), F.struct(u.alias("url"), d.alias("source_id")))))
        return F.when(u.startswith(PORTAL + PDF_PAGE), let(F.try_url_decode(F.regexp_extract(u, r"[?&]id1=([^&#]+)", 1)), source))

    return let(url, read)


def portal_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Records of saved result pages, a page in one row: page_id, portal_row, source_id, source_url, the FIELDS, link_text. The header of a table is its first row of at
    least LEAST_FIELDS named fields without links; later rows with a valid link are records. A column that is both department and section holds
    the department on its first line and the section on the rest."""
    linked = lambda r: F.exists(r["cells"], lambda c: F.size(c["links"]) > 0)

    def fields(r: Column) -> Column:
        labels = F.transform(r["cells"], lambda c: _in_line(c["text"]))
        place = lambda x, p: F.nullif(F.array_position(F.transform(x, lambda c: c.rlike(p)), True), F.lit(0)) - 1
        return let(labels, lambda x: F.struct(*[place(x, p).cast("int").alias(f) for f, p in FIELDS.items()]))

    # a page's headers and records meet in its row: it is read once, and no rows of pages are sorted; rows stand in order, so the first header of a table is the highest
    named = lambda at: sum((F.when(at[f].isNotNull(), 1).otherwise(0) for f in FIELDS), F.lit(0))
    heads = F.filter(F.transform(F.filter("_rows", lambda r: ~linked(r)), lambda r: F.struct(r["table"].alias("table"), r["row"].alias("row"), fields(r).alias("at"))), lambda h: named(h["at"]) >= LEAST_FIELDS)
    first_link = lambda links: F.get(F.filter(F.transform(links, lambda a: F.struct(portal_link(a["href"]).alias("to"), a["label"].alias("label"))), lambda a: a["to"].isNotNull()), F.lit(0))

    def record(r: Column) -> Column:
        head = F.get(F.filter("_heads", lambda h: (h["table"] == r["table"])), F.lit(0))
        return F.struct(F.transform(r["cells"], lambda c: c["text"]).alias("cells"), r["row"].alias("row"), head.alias("head"), first_link(F.flatten(F.transform(r["cells"], lambda c: c["links"]))).alias("link"))

    records = F.filter(F.transform(F.filter("_rows", linked), record), lambda x: x["link"].isNotNull() & (x["row"] > x["head"]["row"]))
    r = pages.select("page_id", grids(F.col(html)).alias("_rows")).select("page_id", heads.alias("_heads"), "_rows")
    # the outer form, since Spark would else infer a filter that reads all links a second time
    met = r.select("page_id", F.posexplode_outer(records).alias("at", "r")).where("r is not null")
    text = lambda f: F.get("r.cells", F.col(f"r.head.at.{f}"))
    met = met.select("page_id", (F.col("at") + 1).alias("portal_row"), F.col("r.link").alias("link"), (F.col("r.head.at.department") == F.col("r.head.at.section")).alias("both"), *[text(f).alias(f) for f in FIELDS])
    value = lambda c: F.nullif(_in_line(c), F.lit(""))
    out = {f: value(F.col(f)) for f in FIELDS}
    # lines of a cell are never empty
    out["department"] = F.when(F.col("both"), F.nullif(F.substring_index("department", "\n", 1), F.lit(""))).otherwise(out["department"])
    rest = F.substr(F.col("section"), F.locate("\n", F.col("section")) + 1)
    out["section"] = F.when(F.col("both"), F.when(F.col("section").contains("\n"), _in_line(rest))).otherwise(out["section"])
    return met.select("page_id", "portal_row", F.col("link.to.source_id").alias("source_id"), F.col("link.to.url").alias("source_url"), *[c.alias(f) for f, c in out.items()], F.nullif("link.label", F.lit("")).alias("link_text"))


def portal_total(html: Column) -> Column:
    """The number of results that a page states, else null."""
    plain = P.plain_text(html)
    return F.coalesce(*[F.nullif(F.replace(F.regexp_extract(plain, p, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("long") for p in TOTALS])


def order_kind(title: Column) -> Column:
    return F.when(title.rlike(REVISION), "revision-order").otherwise("government-order")


def _has(c: Column, *parts: str) -> Column:
    return reduce(or_, [c.contains(x) for x in parts])


def _visible(c: Column) -> Column:
    """Without zero-width characters, of which ASCII has none."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(_one_line(F.translate(c, "​‌‍﻿", "")))


def _clean(lines: Column) -> Column:
    """Lines without zero-width characters, sizes and languages; most have none."""
    mended = lambda c: F.regexp_replace(F.regexp_replace(c, SIZE_OR_LANGUAGE.replace(r"\s", " "), " "), "(?m)^ +| +$|( ) +", "$1")
    ascii = F.octet_length(lines) == F.length(lines)
    return F.when(ascii & ~_has(F.lower(lines), "kb", "mb", "size", "language"), lines).when(ascii, mended(lines)).otherwise(mended(F.translate(lines, "​‌‍﻿", "")))


def _lines(text: Column, pattern: str) -> Column:
    """The lines that hold the pattern, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?m)^.*{pattern}.*$"), F.lit(0))


def _undated(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, TRAILING_DATE, ""))


def _number(lines: Column) -> Column:
    """An order's number by the first of the clean lines that looks like one. Only lines with a slash or a dash can."""
    return F.get(F.filter(F.transform(_lines(lines, "[/-]"), lambda t: P.order_number(_undated(t))), lambda v: v.isNotNull()), F.lit(0))


def _date(lines: Column) -> Column:
    """The day of the first line that is nothing but a date, else of the first with one."""
    days = F.filter(F.transform(lines, lambda t: F.struct(P.any_date(t).alias("day"), t.alias("t"))), lambda x: x["day"].isNotNull())
    return let(days, lambda d: F.coalesce(F.get(F.filter(d, lambda x: P.is_date_only(x["t"])), F.lit(0)), F.get(d, F.lit(0)))["day"])


def _longest(lines: Column) -> Column:
    return F.reduce(lines, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))


def _title(lines: Column, longest: Column) -> Column:
    """The longest of the clean lines that says something, of short ones where there are any. Mostly that is the longest of all."""
    serial = r"^\s*\d{1,5}\s*\.?\s*$"
    says = lambda t: (F.length(t) >= 6) & ~t.rlike(GENERIC_LABEL) & ~t.rlike(serial) & ~P.is_date_only(t) & ~(_has(t, "/", "-") & P.looks_like_number(t))
    shortened = lambda best: F.when(F.length(best) > LONG_TITLE, F.concat(F.rtrim(F.substring(best, 1, LONG_TITLE - 3)), F.lit("…"))).otherwise(F.nullif(best, F.lit("")))

    def choose(options: Column) -> Column:
        pool = let(F.filter(options, lambda t: F.length(t) <= SHORT_TITLE), lambda short: F.when(F.exists(short, lambda t: F.length(t) >= 20), short).otherwise(options))
        return let(_longest(pool), shortened)

    return F.when((F.length(longest) >= 20) & (F.length(longest) <= SHORT_TITLE) & says(longest), longest).otherwise(let(F.filter(F.split(lines, "\n"), says), choose))


def row_items(pages: DataFrame, html: str = "html", site_language: str = "both", documents: str = r"(?i)\.pdf(?:[?#]|$)") -> DataFrame:
    """pages (page_id, html), a page in one row -> page_id, url, title, label, go_number, go_date, language, n_cells: each document that a table row links to, with what the cells
    beside the link say. A row of more than MOST_LINKS links says nothing about each; a document that is linked twice has its fuller row, then the first."""

    def linked(r: Column) -> Column:
        texts = F.filter(F.transform(r["cells"], lambda c: _in_line(c["text"])), lambda t: t != "")

        def found(links: Column) -> Column:
            told = F.when(F.size(links) > MOST_LINKS, F.array().cast("array<string>")).otherwise(texts)
            item = lambda x: lambda a, i: F.struct(a["href"].alias("url"), (-F.size(x)).alias("n"), r["table"].alias("table"), r["row"].alias("row"), i.alias("at"), a["label"].alias("label"), x.alias("texts"))
            return let(F.filter(links, lambda a: a["href"].rlike(documents)), lambda held: F.when(F.size(held) > 0, let(told, lambda x: F.transform(held, item(x)))).otherwise(F.transform(held, item(F.array().cast("array<string>")))))

        return let(F.flatten(F.transform(r["cells"], lambda c: c["links"])), found)

    # a page's links meet in its row: only the fullest row of each document is looked at, and no rows of pages are sorted
    ordered = lambda rows: F.sort_array(F.flatten(F.transform(rows, linked)))
    firsts = lambda x: F.filter(x, lambda a, i: (i == 0) | (F.get(x, i - 1)["url"] != a["url"]))
    # the outer form, since Spark would else infer a filter that finds all items a second time
    each = pages.select("page_id", grids(F.col(html)).alias("_rows")).select("page_id", F.inline_outer(let(ordered(F.col("_rows")), firsts))).where("url is not null")
    each = each.select("page_id", "url", "texts", _visible(F.col("label")).alias("label"))
    # texts are lines of one text, so that patterns choose the few that have to be looked at; without a cell the label stands for one
    each = each.select("page_id", "url", "label", F.size("texts").alias("n_cells"), F.array_join("texts", "\n").alias("cells"))
    told = F.when(F.col("n_cells") > 0, F.col("cells")).otherwise(F.col("label"))
    stated = F.when(_has(F.lower("cells"), "language", "भाषा"), F.lower(F.regexp_extract(F.replace("cells", F.lit("\n"), F.lit(" | ")), STATED_LANGUAGE, 1))).otherwise("")
    # each form of a date ends with four digits after a sign or a blank; what the one line with a date says, or the first that is nothing else, mostly is the day
    dates, alone = _lines(told, DATE_END), F.regexp_extract(told, DATE_LINE, 0)
    each = each.select("page_id", "url", "label", "n_cells", stated.alias("stated"), dates.alias("dates"), alone.alias("alone"), _clean(F.col("cells")).alias("cells"), _clean(F.col("label")).alias("clean"))
    lines, sole = F.concat_ws("\n", "cells", "clean"), F.when(F.col("alone") != "", F.col("alone")).when(F.size("dates") == 1, F.get("dates", F.lit(0)))
    # the first line with a slash or a dash mostly is the number
    numbers = F.concat_ws("\n", "clean", "cells")
    undated = F.when(_has(numbers, "/", "-"), _undated(F.regexp_extract(numbers, "(?m)^.*[/-].*$", 0)))
    each = each.select("*", lines.alias("lines"), _longest(F.split(lines, "\n")).alias("longest"), P.unlabelled(undated).alias("number"), P.any_date(sole).alias("day"))
    number = F.when(P.is_number(F.col("number")), F.col("number")).when(F.col("number").isNotNull(), _number(numbers))
    day = F.coalesce("day", F.when((F.size("dates") > 1) | (F.col("alone") != ""), _date(F.col("dates"))))
    file = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"([^/]*?)(?:\.pdf)?(?:[?#].*)?$", 1), "%20", " "), "[_-]+", " "))
    plain = F.when((F.col("clean") != "") & ~F.col("clean").rlike(GENERIC_LABEL), F.col("clean"))
    title = F.coalesce(_title(F.col("lines"), F.col("longest")), plain, F.nullif(file, F.lit("")), F.lit("Document"))
    each = each.select("page_id", "url", title.alias("title"), "label", "n_cells", number.alias("number"), day.alias("go_date"), "stated")
    guessed = language(F.col("title"))
    guessed = F.when(guessed == "unknown", site_language).otherwise(guessed) if site_language in ("hi", "en") else guessed
    spoken = F.when(F.col("stated") == "", guessed).otherwise(F.when(F.col("stated").rlike("hindi|हिंदी|हिन्दी"), "hi").otherwise("en"))
    go_number = F.coalesce("number", F.nullif(F.trim(F.regexp_extract("title", NUMBER_IN_TITLE, 1)), F.lit("")))
    return each.select("page_id", "url", "title", "label", go_number.alias("go_number"), "go_date", spoken.alias("language"), "n_cells")

"""A register of rules and the orders that changed them, met with the evidence of many questions at once.

register: entry, place (its order), rule. pages: entry, kind (rule, current or order), at (order within the kind), source_id, page_number: where the rule is
printed, where it is stated as it is now, and the amending orders. triggers, contexts: entry, phrase. Evidence: query, place (its rank), source_id, page_number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import phrase_hits

MOST_PAGES = 6
#: Order in which an entry's pages are read.
KINDS = ["rule", "current", "order"]


def triggered(questions: DataFrame, triggers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query, entry) whose question names a trigger, and one of the entry's contexts where it has any."""
    named = phrase_hits(questions, triggers).select("query", "entry").distinct()
    around = phrase_hits(questions, contexts).select("query", "entry").distinct().withColumn("_in", F.lit(True))
    gated = contexts.select("entry").distinct().withColumn("_gate", F.lit(True))
    return named.join(gated, "entry", "left").join(around, ["query", "entry"], "left").where("_gate is null or _in").select("query", "entry")


def matched(evidence: DataFrame, pages: DataFrame, questions: DataFrame, triggers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query, entry): entries with a page among the evidence, entries changed by an order of which any page is, if that order is no
    part of the book itself, and entries that the question names."""
    by_page = evidence.select("query", "source_id", "page_number").join(pages.select("entry", "source_id", "page_number"), ["source_id", "page_number"]).select("query", "entry")
    books = pages.where("kind <> 'order'").select("entry", "source_id").distinct()
    orders = pages.where("kind = 'order'").select("entry", "source_id").distinct().join(books, ["entry", "source_id"], "left_anti")
    by_order = evidence.select("query", "source_id").distinct().join(orders, "source_id").select("query", "entry")
    return by_page.union(by_order).union(triggered(questions, triggers, contexts)).distinct()


def missing_pages(found: DataFrame, register: DataFrame, pages: DataFrame, evidence: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(query, n, source_id, page_number): pages of the matched entries that the evidence lacks, in the order of the entries, then rule, current
    and order pages; `most` at the most, each once."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    each = found.join(register.select("entry", "place"), "entry").join(pages.select("entry", rank.alias("kind"), "at", "source_id", "page_number"), "entry")
    first = each.groupBy("query", "source_id", "page_number").agg(F.min(F.struct("place", "kind", "at")).alias("o"))
    new = first.join(evidence.select("query", "source_id", "page_number").distinct(), ["query", "source_id", "page_number"], "left_anti")
    order = Window.partitionBy("query").orderBy("o", "source_id", "page_number")
    return new.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query", "n", "source_id", "page_number")


def append_evidence(evidence: DataFrame, extra: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """(query, label, source_id, page_number, added): evidence in its order, then what extra (query, n, source_id, page_number) adds to it, labelled S1, S2
    and so on. With an archive (source_id, page_number) only pages that it has are added."""
    if archive is not None:
        extra = extra.join(archive.select("source_id", "page_number").distinct(), ["source_id", "page_number"], "left_semi")
    new = extra.join(evidence.select("query", "source_id", "page_number").distinct(), ["query", "source_id", "page_number"], "left_anti")
    both = evidence.select("query", F.lit(False).alias("added"), F.col("place").cast("long").alias("o"), "source_id", "page_number")
    both = both.union(new.select("query", F.lit(True), F.col("n").cast("long"), "source_id", "page_number"))
    n = F.row_number().over(Window.partitionBy("query").orderBy("added", "o", "source_id", "page_number"))
    return both.select("query", F.concat(F.lit("S"), n.cast("string")).alias("label"), "source_id", "page_number", "added")


def card_notes(register: DataFrame, pages: DataFrame, orders: DataFrame) -> DataFrame:
    """orders (entry, at, go_number, go_date) -> (source_id, direction, rule, go_number, go_date, go_source_id): on the card of a book that prints a rule the
    orders that amended it, on the card of an order of its own the rule that it amends. Books that state the present rule are not amended."""
    own = pages.where("kind = 'order'").select("entry", "at", F.col("source_id").alias("go_source_id"))
    notes = orders.join(own, ["entry", "at"], "left").join(register.select("entry", "rule"), "entry")
    books = pages.where("kind = 'rule'").select("entry", "source_id").distinct()
    columns = ["rule", "go_number", "go_date", "go_source_id"]
    on_books = notes.join(books, "entry").select("source_id", F.lit("amended_by").alias("direction"), *columns)
    apart = notes.where("go_source_id is not null").join(books.withColumnRenamed("source_id", "go_source_id"), ["entry", "go_source_id"], "left_anti")
    return on_books.union(apart.select(F.col("go_source_id").alias("source_id"), F.lit("amends").alias("direction"), *columns)).distinct()


def note_line(go_number: Column, go_date: Column, change: Column, on_page: Column) -> Column:
    """How a prompt names an amending order: its date if there is one, what it changed, and whether its text can be cited."""
    day = F.coalesce(F.date_format(go_date, "dd.MM.yyyy"), F.lit("date not recorded"))
    where = F.coalesce(F.concat(F.lit("text on "), on_page), F.lit("GO not in the archive; name it, do not cite it"))
    return F.concat(F.lit("Amended by GO "), go_number, F.lit(" dated "), day, F.when(F.coalesce(change, F.lit("")) != "", F.concat(F.lit(" — "), change)).otherwise(""), F.lit(" ("), where, F.lit(")"))

"""Evidence as the text that a model reads: a block for each page, clipped by its role, packed into a budget; and the index of a handbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pages import authority_label, jurisdiction_label, named_entities, numeric_entities
from ..functions.text import let
from .answers import masked_numbers

# Limits of a page's text by its role, of its second text, and what stands between pages, after clipped text and for no evidence.
DIRECT, NEIGHBOUR, CANONICAL = 2800, 1200, 1400
BETWEEN = "\n\n============================================================\n\n"
CLIPPED = "\n[...page text clipped...]"
NO_EVIDENCE = "NO EVIDENCE WAS RETRIEVED."
WITHHELD = "withheld-risky-numeric-metadata"
JURISDICTIONS = {"IN": "Government of India (central)", "UP": "Uttar Pradesh (state)"}
PARAGRAPHS = r"^\d[\d\s.,–—-]*[A-Z]?(?:\s*[–—-]\s*\d+[\s–—-]*[A-Z]?)*$"
FILE_NUMBER = r"^\d{3}$"


def clip(c: Column, most: Column | int) -> Column:
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.length(c) > most, F.concat(F.substr(c, F.lit(1), most), F.lit(CLIPPED))).otherwise(c)


def evidence_block(rulebooks: list[str]) -> Column:
    """A page of evidence with its header. Reads label, source_id, page_number, role (direct or neighbor), anchor_page, jurisdiction_code, provider, tier, department,
    go_number, go_date (text), variant, canonical, conflict, verification, status, selected_text, canonical_text, later_changes. Of a page whose numbers are in doubt no number is
    shown, neither in its text nor in its header, and no second text."""
    risky = F.col("verification").isin("conflict", "ocr_only_unverified", "unverified")
    hidden = lambda c: F.when(risky, WITHHELD).otherwise(F.coalesce(c, F.lit("unknown")))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "YES").otherwise("NO")
    authority = authority_label(F.col("provider"), F.col("tier"), rulebooks)
    header = F.concat_ws(
        "\n", F.concat(F.lit("SOURCE "), "label"), F.concat(F.lit("SOURCE_ID="), F.when(risky, WITHHELD).otherwise(F.col("source_id"))), F.concat(F.lit("PAGE="), "page_number"),
        F.concat(F.lit("RETRIEVAL_ROLE="), F.coalesce("role", F.lit("direct"))), F.concat(F.lit("ANCHOR_PAGE="), F.coalesce(F.col("anchor_page").cast("string"), F.lit("none"))),
        F.concat(F.lit("JURISDICTION="), jurisdiction_label(F.col("jurisdiction_code"), JURISDICTIONS)), F.concat(F.lit("AUTHORITY="), authority), F.concat(F.lit("DEPARTMENT="), F.coalesce("department", F.lit("unknown"))),
        F.concat(F.lit("GO_NUMBER="), hidden(F.col("go_number"))), F.concat(F.lit("GO_DATE="), hidden(F.col("go_date"))), F.concat(F.lit("SELECTED_VARIANT="), "variant"), F.concat(F.lit("SELECTED_CANONICAL="), yes(F.col("canonical"))),
        F.concat(F.lit("NUMERIC_CONFLICT="), yes(F.col("conflict"))), F.concat(F.lit("NUMERIC_VERIFICATION_STATUS="), "verification"), F.concat(F.lit("GENERATION_NUMERICS_MASKED="), yes(risky)),
        F.when(F.col("status").isNotNull() & (F.col("status") != "current"), F.concat(F.lit("STATUS="), F.upper("status"))), F.concat(F.lit("LATER_CHANGES="), "later_changes"),
    )
    most = F.when(F.col("role") == "neighbor", NEIGHBOUR).otherwise(DIRECT)
    selected = F.concat(F.lit("SELECTED PAGE TEXT:\n"), clip(masked_numbers(F.coalesce("selected_text", F.lit("")), risky), most))
    second = F.when(~risky & ~F.col("canonical_text").eqNullSafe(F.col("selected_text")), F.concat(F.lit("CANONICAL PAGE TEXT:\n"), clip(F.coalesce("canonical_text", F.lit("")), CANONICAL)))
    return F.concat_ws("\n\n", header, selected, second)


def evidence_context(evidence: DataFrame, rulebooks: list[str], budget: int | None = None) -> DataFrame:
    """evidence (query, place, and what a block reads) -> (query, blocks, n_chars, context): the blocks of each query in rank order. With a budget of characters a block
    that does not fit what is left of it is passed over, and later ones that fit are taken, so the context is never longer."""
    each = evidence.select("query", F.struct("place", "label", evidence_block(rulebooks).alias("text")).alias("b"))
    held = each.groupBy("query").agg(F.array_sort(F.collect_list("b")).alias("b"))
    texts = F.transform("b", lambda b: b["text"])
    if budget is not None:
        gap = len(BETWEEN)
        start = F.struct(F.lit(-gap).alias("used"), F.array().cast("array<string>").alias("kept"))

        def take(s: Column, t: Column) -> Column:
            longer = s["used"] + gap + F.length(t)
            return F.when(longer <= budget, F.struct(longer.alias("used"), F.concat(s["kept"], F.array(t)).alias("kept"))).otherwise(s)

        texts = F.aggregate(texts, start, take, lambda s: s["kept"])
    packed = held.select("query", texts.alias("t")).select("query", F.size("t").alias("blocks"), F.array_join("t", BETWEEN).alias("context"))
    return packed.select("query", "blocks", F.length("context").alias("n_chars"), "context")


def no_evidence(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """queries (query) with their context, or the words that say there is none."""
    return queries.join(contexts, "query", "left").select("query", F.coalesce("context", F.lit(NO_EVIDENCE)).alias("context"))


def handbook_links(indexes: DataFrame) -> DataFrame:
    """indexes (volume, url, html) -> (volume, place, url, label, page): links of an index in reading order that stay inside its folder; page: whether it is an HTML
    page. Links to the index itself, to other folders and hosts, and to parts of a page are navigation and leave."""
    folder, host = F.regexp_extract("url", r"^(.*/)[^/]*$", 1), F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    held = indexes.select("volume", F.col("url").alias("index_url"), folder.alias("folder"), host.alias("host"), F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0)).alias("found"))
    # addresses and labels are made inside the array, once for each link; a quoted address ends at its quote, so one with a single quote is not quoted
    value = lambda a: F.regexp_extract(a, r"""(?is)^<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    quoted = lambda v, q: v.startswith(q) & v.endswith(q) & (F.length(v) > 1)
    href = lambda a: let(value(a), lambda v: F.when(quoted(v, '"') | quoted(v, "'"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    label = lambda a: named_entities(F.regexp_replace(a, r"<[^>]+>", " "))
    raw = F.transform("found", lambda a, i: F.struct(i.alias("place"), F.trim(F.replace(href(a), F.lit("&amp;"), F.lit("&"))).alias("raw"), a.alias("a")))
    raw = F.filter(raw, lambda x: (x["raw"] != "") & ~x["raw"].rlike(r"(?i)^(?:javascript:|mailto:|#)"))
    whole = lambda r: F.when(r.rlike("(?i)^https?://"), r).when(r.startswith("/"), F.concat("host", r)).otherwise(F.concat("folder", F.regexp_replace(r, r"^(?:\./)+", "")))
    links = F.transform(raw, lambda x: F.struct(x["place"].alias("place"), F.regexp_replace(whole(x["raw"]), "#.*$", "").alias("url"), label(x["a"]).alias("label")))
    links = F.filter(links, lambda x: x["url"].startswith(F.col("folder")) & ~x["url"].contains("/../") & (x["url"] != F.col("index_url")))
    each = held.select("volume", F.explode(links).alias("l")).select("volume", "l.place", "l.url", "l.label")
    return each.select("volume", "place", "url", F.trim(F.regexp_replace(numeric_entities(F.col("label")), r"\s+", " ")).alias("label"), F.col("url").rlike(r"(?i)\.(?:html?|hmt)(?:\?|$)").alias("page"))


def handbook_index(indexes: DataFrame) -> DataFrame:
    """indexes (volume, url, html) -> (volume, n, url, label): the pages of each volume by first link. Labels of one page are merged, each once: titles, then ranges of
    paragraphs; bare file numbers say nothing."""
    links = handbook_links(indexes).where("page")
    once = links.groupBy("volume", "url", "label").agg(F.min("place").alias("place"))
    parts = once.groupBy("volume", "url").agg(F.min("place").alias("place"), F.transform(F.array_sort(F.collect_list(F.when((F.col("label") != "") & ~F.col("label").rlike(FILE_NUMBER), F.struct("place", "label")))), lambda x: x["label"]).alias("labels"))
    # the place of a page is that of its first link, whatever its label
    ranges, titles = F.filter("labels", lambda x: x.rlike(PARAGRAPHS)), F.filter("labels", lambda x: ~x.rlike(PARAGRAPHS))
    parts = parts.select("volume", "url", "place", F.array_join(titles, " — ").alias("title"), F.array_join(ranges, ", ").alias("spans"))
    title, spans = F.col("title"), F.col("spans")
    label = F.when((title != "") & (spans != ""), F.concat(title, F.lit(" (paras "), spans, F.lit(")"))).when(title != "", title).when(spans != "", F.concat(F.lit("Paras "), spans)).otherwise("")
    n = F.row_number().over(Window.partitionBy("volume").orderBy("place", "url"))
    return parts.select("volume", n.alias("n"), "url", label.alias("label"))


def compressed_ranges(numbers: DataFrame, key: str) -> DataFrame:
    """numbers (key, first, last) -> (key, ranges): numbers as the fewest ranges, such as "1-4, 7": ranges that meet or overlap are one island. The rows of a
    key are sorted once: where an island begins, the one before it ends at the greatest number so far."""
    order = Window.partitionBy(key).orderBy("first", "last")
    upto = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # a stated number of tasks, which Spark does not merge: the sorted rows are more than the bytes tell
    dealt = numbers.where("first <= last").repartition(int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    begins = dealt.withColumn("_upto", upto).select(key, "last", F.when(F.col("_upto").isNull() | (F.col("first") > F.col("_upto") + 1), F.struct("first", "_upto")).alias("_begin"))
    islands = begins.groupBy(key).agg(F.array_sort(F.collect_list("_begin")).alias("b"), F.max("last").alias("_last"))

    def text(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("b", k + 1)["_upto"], F.col("_last"))
        return F.when(begin["first"] == end, end.cast("string")).otherwise(F.concat_ws("-", begin["first"].cast("string"), end.cast("string")))

    return islands.select(key, F.array_join(F.transform("b", text), ", ").alias("ranges"))

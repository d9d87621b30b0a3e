"""Listings of portals: attachments, two languages, pagers, registers, page batches, volumes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pages import decode_entities


def anchors(html: Column) -> Column:
    """array<struct<href, label>> of the links of a page, in order; the label is the link's text, else its title."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    attribute = lambda t, name: F.regexp_extract(t, rf"(?i)^<a\b[^>]*?\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    text = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))
    items = F.transform(found, lambda t: F.struct(attribute(t, "href").alias("href"), F.coalesce(F.nullif(text(t), F.lit("")), attribute(t, "title")).alias("label")))
    return F.filter(items, lambda a: a["href"] != "")


def listing_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages (page_id, html) -> (page_id, url, label): each linked document once, under its longest label."""
    each = pages.select("page_id", F.inline(anchors(F.col(html))))
    best = each.groupBy("page_id", "href").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("label"))
    return best.select("page_id", F.col("href").alias("url"), "label")


def postbacks(html: Column) -> Column:
    """Distinct (target, argument) of a grid's pager."""
    found = F.regexp_extract_all(decode_entities(html), F.lit(r"__doPostBack\('[^']+','Page\$(?:\d+|Next|Last|First|Prev)'\)"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.struct(F.regexp_extract(t, r"\('([^']+)'", 1).alias("target"), F.regexp_extract(t, r",'([^']+)'", 1).alias("argument"))))


def totals(html: Column) -> Column:
    """struct(total, page_size) of "Displaying a - b of n", else null."""
    part = lambda k: F.regexp_extract(decode_entities(html), r"(?i)Displaying\s+(\d+)\s*-\s*(\d+)\s+of\s+(\d+)", k).cast("long")
    return F.when(decode_entities(html).rlike(r"(?i)Displaying\s+\d+\s*-\s*\d+\s+of\s+\d+"), F.struct(part(3).alias("total"), (part(2) - part(1) + 1).alias("page_size")))


def pager_links(links: DataFrame) -> DataFrame:
    """links (page_id, page_url, url) -> those that lead to other pages of the same listing: same host and path, and a page number."""
    host, path = (lambda c, what: F.parse_url(c, F.lit(what))), (lambda c: F.regexp_replace(F.coalesce(F.parse_url(c, F.lit("PATH")), F.lit("")), r"/page/\d+/?$", "/"))
    numbered = F.coalesce(F.parse_url("url", F.lit("QUERY")).rlike(r"(?i)(^|&)(page|pg|p|pageno|page_no|start)="), F.lit(False)) | F.coalesce(F.parse_url("url", F.lit("PATH")).rlike(r"/page/\d+/?$"), F.lit(False))
    same = (host(F.col("url"), "HOST") == host(F.col("page_url"), "HOST")) & (path(F.col("url")) == path(F.col("page_url")))
    return links.where(same & numbered & (F.col("url") != F.col("page_url"))).select("page_id", "url").distinct()


def attachments(posts: DataFrame, hosts: list[str]) -> DataFrame:
    """posts (place, site, post_id, title, date, files: array of struct(key, language, date, url)) -> one document for each PDF on an
    allowed host: source_id with a language suffix only where the post has several, the file's date before the post's; the
    first place of an id counts."""
    each = posts.select("place", "site", "post_id", F.trim("title").alias("title"), "date", F.posexplode("files").alias("at", "f"))
    pdf = (F.parse_url("f.url", F.lit("PROTOCOL")) == "https") & F.parse_url("f.url", F.lit("HOST")).isin(hosts) & F.parse_url("f.url", F.lit("PATH")).rlike(r"(?i)\.pdf$")
    each = each.where(F.coalesce(pdf, F.lit(False)))
    several = F.count("*").over(Window.partitionBy("place", "site", "post_id")) > 1
    suffix = F.when(several, F.concat(F.lit("-"), F.when(F.col("f.language").isin("hi", "en"), F.col("f.language")).otherwise(F.col("f.key")))).otherwise("")
    named = each.withColumn("source_id", F.concat_ws("-", "site", F.concat(F.col("post_id").cast("string"), suffix)))
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("place", "at"))
    # a stated number of tasks, which Spark does not merge: the sorted rows are more than the bytes tell
    dealt = named.repartition(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id")
    kept = dealt.withColumn("_n", first).where("_n = 1")
    return kept.select("source_id", "title", F.col("f.url").alias("url"), F.coalesce("f.date", "date").alias("go_date"), F.col("f.language").alias("language"))


def merge_languages(links: DataFrame) -> DataFrame:
    """links (language, place, url, title, listing) -> one row for each url: first title of each language, listings in order, and
    the Hindi title, else the English one, else the url."""
    title = lambda code: F.min_by(F.when(F.col("language") == code, F.col("title")), F.when(F.col("language") == code, F.col("place")))
    lists = F.array_sort(F.collect_set("listing"))
    got = links.groupBy("url").agg(title("hi").alias("hi"), title("en").alias("en"), lists.alias("listings"))
    return got.select("url", "hi", "en", "listings", F.coalesce("hi", "en", "url").alias("title"))


def register_problems(sites: DataFrame, levels: list[str], official: str) -> DataFrame:
    """sites (place, id, level, listing_urls) -> (id, place, problem): the first rule that a site breaks; official is a pattern of
    allowed hosts. A second site with an id is a problem, the first is not."""
    second = F.row_number().over(Window.partitionBy("id").orderBy("place")) > 1
    bad = F.get(F.filter("listing_urls", lambda u: ~F.coalesce(F.regexp_like(u, F.lit(r"^https?://[^/\s]+")), F.lit(False))), F.lit(0))
    foreign = F.get(F.filter(F.transform("listing_urls", lambda u: F.regexp_extract(u, r"^https?://([^/:?#]+)", 1)), lambda h: (h != "") & ~F.regexp_like(h, F.lit(official))), F.lit(0))
    rule = (
        F.when(~F.col("id").rlike(r"^[a-z0-9][a-z0-9-]{1,40}$"), "id must be 2-41 lowercase letters, digits and dashes")
        .when(F.col("_second"), "duplicate id").when(~F.col("level").isin(levels), F.lit("level must be one of " + ", ".join(levels)))
        .when(F.coalesce(F.size("listing_urls"), F.lit(0)) < 1, "no listing URLs").when(bad.isNotNull(), F.concat(F.lit("bad URL "), bad))
        .when(foreign.isNotNull(), F.concat(foreign, F.lit(" is not on the host list")))
    )
    return sites.withColumn("_second", second).select("place", "id", rule.alias("problem")).where("problem is not null")


def site_hosts(sites: DataFrame) -> DataFrame:
    """(id, host, plain): the hosts a site may be read from, with and without www, and whether plain http is allowed there."""
    each = sites.select("id", F.explode("listing_urls").alias("u")).select("id", F.regexp_extract("u", r"^https?://([^/:?#]+)", 1).alias("h"), F.col("u").startswith("http:").alias("plain"))
    twin = F.when(F.col("h").startswith("www."), F.substring("h", 5, 1000)).otherwise(F.concat(F.lit("www."), "h"))
    return each.select("id", F.explode(F.array("h", twin)).alias("host"), "plain").groupBy("id", "host").agg(F.bool_or("plain").alias("plain"))


def page_batches(batches: DataFrame) -> DataFrame:
    """batches (listing, seq, page, page_size, ids: array) -> what each does to the ledger of its listing: saved, repeated (same orders
    again) or reshuffled (other orders under a known page), with the new orders it adds. A changed page size starts the
    pages of a listing again; orders stay known. Sums and first places replace a row-by-row fold."""
    own = Window.partitionBy("listing").orderBy("seq")
    size = F.last("page_size", True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = batches.withColumn("_size", size).withColumn("_reset", F.when(F.col("_size").isNotNull() & (F.col("page_size") != F.col("_size")), 1).otherwise(0))
    marked = marked.withColumn("_epoch", F.sum("_reset").over(own)).withColumn("digest", F.sha2(F.array_join("ids", "\n"), 256))
    first = F.first("digest").over(Window.partitionBy("listing", "_epoch", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.partitionBy("listing", "_epoch", "page").orderBy("seq"))
    kind = F.when(F.col("_nth") == 1, "saved").when(F.col("digest") == F.col("_first"), "repeated").otherwise("reshuffled")
    marked = marked.withColumn("_first", first).withColumn("_nth", nth).withColumn("kind", kind)
    # an order is new in the first batch, repeats apart, that holds it
    seen = marked.where("kind <> 'repeated'").select("seq", F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").agg(F.min("seq").alias("seq"))
    added = seen.groupBy("seq").agg(F.count("*").alias("added"))
    return marked.join(added, "seq", "left").select("listing", "seq", "page", "kind", F.coalesce("added", F.lit(0)).alias("added"))


def volume_parts(parts: DataFrame) -> DataFrame:
    """parts (volume, title, chapter_no, chapter, part_no, text) -> text under a header with its volume, chapter and part, and its page:
    a running number over the chapters of the volume."""
    n = F.count("*").over(Window.partitionBy("volume", "chapter_no"))
    note = F.when(n > 1, F.concat(F.lit(" (part "), F.col("part_no").cast("string"), F.lit(" of "), n.cast("string"), F.lit(")"))).otherwise("")
    page = F.row_number().over(Window.partitionBy("volume").orderBy("chapter_no", "part_no"))
    return parts.select("volume", page.alias("page"), F.concat(F.lit("["), "title", F.lit(" — "), "chapter", note, F.lit("]\n"), "text").alias("text"))


def split_text(text: Column, most: int = 3500) -> Column:
    """Lines of a text gathered into parts of at most `most` characters; longer lines are cut every `most` characters."""
    lines = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most)), lambda i: F.substr(x, (i * most + 1).cast("int"), F.lit(most))))))
    step = lambda s, x: F.when(F.size(s) == 0, F.array(x)).when(F.length(F.element_at(s, -1)) + 1 + F.length(x) > most, F.concat(s, F.array(x))).otherwise(F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.concat(F.element_at(s, -1), F.lit("\n"), x))))
    return F.aggregate(lines, F.array().cast("array<string>"), step)


def department_sections(orders: DataFrame) -> DataFrame:
    """orders (query, rank, key, label, pages) -> sections by department key: place by its best order, orders, pages, and its distinct
    spellings in order of appearance."""
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]))
    got = orders.groupBy("query", "key").agg(F.min("rank").alias("best"), F.count("*").alias("orders"), F.sum("pages").alias("pages"), names.alias("names"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("best"))
    return got.select("query", "key", place.alias("place"), "orders", "pages", F.array_join("names", " · ").alias("label"))


def describe_evidence(evidence: DataFrame) -> DataFrame:
    """(query, sentence): how many pages of how many orders."""
    n = evidence.groupBy("query").agg(F.count("*").alias("p"), F.countDistinct("source_id").alias("o"))
    plural = lambda c, one: F.concat(F.col(c).cast("string"), F.lit(f" {one}"), F.when(F.col(c) == 1, "").otherwise("s"))
    return n.select("query", F.concat(plural("p", "page"), F.lit(" in "), plural("o", "order")).alias("sentence"))


def jurisdiction_report(docs: DataFrame) -> DataFrame:
    """(code, documents, superseded, drafts), ? for none."""
    return docs.groupBy(F.coalesce("jurisdiction_code", F.lit("?")).alias("code")).agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "superseded").alias("superseded"), F.count_if(F.col("status") == "draft").alias("drafts"))


def markdown_table(rows: DataFrame, order: list[str], most: int = 1000) -> str:
    """A small result, `most` rows in order, as a table in Markdown."""
    got = rows.orderBy(*order).limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in got]) + "\n"



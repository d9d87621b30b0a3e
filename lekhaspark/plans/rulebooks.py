"""Tables of pages, the amendment register, evidence contexts and handbook indexes as queries over pages made of the rows of orders, nations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import amendments as A
from ..operators import answer_pages as E
from ..operators import audits as U
from ..operators import contexts as C
from ..operators import listings, tables
from ..sources import cms
from .registry import query

_LINES = "x AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_partkey) AS part, min(l_suppkey) AS supp, min(CAST(l_shipdate AS DATE)) AS day FROM lineitem GROUP BY 1, 2)"


def _lines(t):
    # dealt by order once, to a stated number of tasks: the pages of orders need no second shuffle
    line = t("lineitem")
    line = line.repartition(int(line.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").groupBy("l_orderkey", "l_linenumber")
    return line.agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min(F.to_date("l_shipdate")).alias("day"))


def _pages(lines, row, before, after="</table>"):
    """One page for each order: `row` of each line, in order."""
    each = lines.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["r"]), "")
    return each.select("page_id", F.concat(F.replace(F.lit(before), F.lit("{n}"), F.size("rows").cast("string")), body, F.lit(after)).alias("html"))


@query(f"""WITH {_LINES}, k AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM x)
SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS portal_row, concat(l_orderkey, '#', part, '#', l_linenumber, '#2020') AS source_id,
'कृषि विभाग' AS department, concat('अनुभाग-', n) AS section, concat(l_linenumber, '/', part) AS go_number, strftime(day, '%d.%m.%Y') AS go_date, concat('supply of ', supp) AS subject FROM k WHERE flag <> 'R'""")
def portal_result_rows(t):
    """Result pages of the portal: the department's cell reaches over all rows; links of flag R lead to another host."""
    coded = F.base64(F.concat_ws("#", "l_orderkey", "part", "l_linenumber", F.lit("2020")).cast("binary"))
    host = F.when(F.col("flag") == "R", "https://example.org").otherwise(tables.PORTAL)
    row = F.concat(
        F.lit("<td>"), "l_linenumber", F.lit("/"), "part", F.lit("</td><td> "), F.date_format("day", "dd.MM.yyyy"), F.lit("</td><td><a href='"), host, F.lit(tables.PDF_PAGE + "?id1="),
        F.replace(coded, F.lit("="), F.lit("%3D")), F.lit("'>supply  of\n"), "supp", F.lit("</a></td></tr><tr>"),
    )
    head = "<table><tr><th>विभाग / अनुभाग</th><th>संख्या</th><th>दिनांक</th><th>विषय</th></tr><tr><td rowspan={n}>कृषि विभाग<br>अनुभाग-{n}</td>"
    found = tables.portal_rows(_pages(_lines(t), row, head))
    return found.select("page_id", "portal_row", "source_id", "department", "section", "go_number", "go_date", "subject")


@query(f"""WITH {_LINES} SELECT l_orderkey AS page_id, concat('/docs/', part, '-', l_linenumber, '.pdf') AS url, concat('Rates of part ', part, ' and their supply') AS title, concat(l_linenumber, '/', part, '/78-2-2021') AS go_number,
strftime(day, '%Y-%m-%d') AS go_date, CASE flag WHEN 'R' THEN 'hi' ELSE 'en' END AS language, CASE flag WHEN 'R' THEN 5 ELSE 4 END AS n_cells FROM x""")
def listing_rows(t):
    """Listings: number and date in one cell or in two, a stated language, and a menu that links every document once more."""
    url = F.concat(F.lit("/docs/"), "part", F.lit("-"), "l_linenumber", F.lit(".pdf"))
    number = F.concat("l_linenumber", F.lit("/"), "part", F.lit("/78-2-2021"))
    day = F.date_format("day", "dd.MM.yyyy")
    cells = F.when(F.col("flag") == "R", F.concat(F.lit("<td>"), number, F.lit("</td><td>"), day, F.lit("</td>"))).otherwise(F.concat(F.lit("<td>"), number, F.lit(" / "), F.date_format("day", "d MMM yyyy"), F.lit("</td>")))
    row = F.concat(F.lit("<tr><td>"), "l_linenumber", F.lit("</td><td>Rates of part "), "part", F.lit(" and their supply</td>"), cells, F.lit("<td><a href='"), url, F.lit("'>View</a> "), F.when(F.col("flag") == "R", "Language: Hindi").otherwise("(1.2 MB)"), F.lit("</td></tr><tr><td><a href="), url, F.lit(">Menu</a></td></tr>"))
    found = tables.row_items(_pages(_lines(t), row, "<table>"))
    return found.select("page_id", "url", "title", "go_number", "go_date", "language", "n_cells")


@query("""WITH e AS (SELECT c_custkey AS query, n_nationkey AS n, n_regionkey AS r, CAST(c_custkey % 6 AS INT) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT query, k, n, CASE k % 3 WHEN 0 THEN concat('book-', r) WHEN 1 THEN concat('go-', n) ELSE 'other' END AS source_id, CASE k % 3 WHEN 0 THEN n WHEN 1 THEN 5 ELSE 1 END AS page_number, concat('book-', r) AS book FROM e),
m AS (SELECT query, 1 AS o, book AS source_id, n AS page_number FROM s WHERE k % 3 = 1 OR k = 5 UNION ALL SELECT query, 2, 'now', n FROM s WHERE k <> 2 UNION ALL SELECT query, 3, concat('go-', n), 1 FROM s WHERE k <> 2),
a AS (SELECT query, 0 AS o, source_id, page_number, false AS added FROM s UNION ALL SELECT query, o, source_id, page_number, true FROM m)
SELECT query, concat('S', row_number() OVER (PARTITION BY query ORDER BY o)) AS label, source_id, CAST(page_number AS INTEGER) AS page_number, added FROM a""")
def amended_evidence(t):
    """A rule for each nation, printed in the book of its region, stated on a page of another and changed by an order. Questions of customers have a page of the book, a page of the
    order, or neither; of these every other one names the nation."""
    n = t("nation").select(F.col("n_nationkey").cast("int").alias("n"), F.col("n_regionkey").alias("r"), "n_name")
    register = n.select(F.col("n").alias("entry"), F.col("n").alias("place"), F.col("n_name").alias("rule"))
    page = lambda kind, source, number: n.select(F.col("n").alias("entry"), F.lit(kind).alias("kind"), F.lit(1).alias("at"), source.alias("source_id"), number.cast("int").alias("page_number"))
    order = F.concat(F.lit("go-"), "n")
    pages = page("rule", F.concat(F.lit("book-"), "r"), F.col("n")).union(page("current", F.lit("now"), F.col("n"))).union(page("order", order, F.lit(1)))
    q = t("customer").join(n, F.col("c_nationkey") == F.col("n")).select(F.col("c_custkey").alias("query"), "n", "r", "n_name", (F.col("c_custkey") % 6).alias("k"))
    kind = F.col("k") % 3
    evidence = q.select("query", F.lit(1).alias("place"), F.when(kind == 0, F.concat(F.lit("book-"), "r")).when(kind == 1, order).otherwise("other").alias("source_id"), F.when(kind == 0, F.col("n")).when(kind == 1, 5).otherwise(1).alias("page_number"))
    asked = q.select("query", F.when(F.col("k") == 5, F.concat(F.lit("Which orders changed the rule of "), "n_name", F.lit("?"))).otherwise("Which orders?").alias("question"))
    triggers = n.select(F.col("n").alias("entry"), F.concat(F.lit("rule of "), "n_name").alias("phrase"))
    found = A.matched(evidence, pages, asked, triggers, triggers.where("false"))
    return A.append_evidence(evidence, A.missing_pages(found, register, pages, evidence))


_BUDGET = 6000
_RISKY = "verification <> 'native_primary' AND verification <> 'variants_agree'"
_HEADER = """concat('SOURCE S', place, chr(10), 'SOURCE_ID=', CASE WHEN risky THEN 'withheld-risky-numeric-metadata' ELSE concat('d', doc_id) END, chr(10), 'PAGE=', doc_id, chr(10), 'RETRIEVAL_ROLE=', role, chr(10), 'ANCHOR_PAGE=none', chr(10),
'JURISDICTION=', CASE lang WHEN 'en' THEN 'Government of India (central)' WHEN 'de' THEN 'Uttar Pradesh (state)' ELSE concat(lang, ' (state)') END, chr(10), CASE WHEN place % 2 = 0 THEN concat('AUTHORITY=CONTEXT', chr(10)) ELSE '' END, 'DEPARTMENT=unknown', chr(10),
'GO_NUMBER=', CASE WHEN risky THEN 'withheld-risky-numeric-metadata' ELSE 'unknown' END, chr(10), 'GO_DATE=', CASE WHEN risky THEN 'withheld-risky-numeric-metadata' ELSE 'unknown' END, chr(10), 'SELECTED_VARIANT=native', chr(10), 'SELECTED_CANONICAL=YES', chr(10), 'NUMERIC_CONFLICT=', CASE WHEN verification = 'conflict' THEN 'YES' ELSE 'NO' END, chr(10),
'NUMERIC_VERIFICATION_STATUS=', verification, chr(10), 'GENERATION_NUMERICS_MASKED=', CASE WHEN risky THEN 'YES' ELSE 'NO' END, CASE WHEN place = 3 THEN concat(chr(10), 'STATUS=SUPERSEDED') ELSE '' END)"""
_MASKED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9०-९]+([.,:/-][0-9०-९]+)*(\\s*%)?', '', 'g'), '\\s+%', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_STEPS = ", ".join(f"t{k} AS (SELECT *, CASE WHEN b{k} IS NOT NULL AND u{k} + 64 + length(b{k}) <= {_BUDGET} THEN u{k} + 64 + length(b{k}) ELSE u{k} END AS u{k + 1}, b{k} IS NOT NULL AND u{k} + 64 + length(b{k}) <= {_BUDGET} AS k{k} FROM {'p' if not k else f't{k - 1}'})" for k in range(5))


@query(f"""WITH d AS (SELECT doc_id, CAST(floor(doc_id / 5) AS BIGINT) AS query, CAST(doc_id % 5 AS INT) AS place, lang, coalesce(text, '') AS text, ['native_primary', 'conflict', 'variants_agree', 'unverified'][CAST(doc_id % 4 AS INT) + 1] AS verification, CASE WHEN doc_id % 5 = 4 THEN 'neighbor' ELSE 'direct' END AS role FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT *, {_RISKY} AS risky FROM d), m AS (SELECT *, CASE WHEN risky THEN {_MASKED} ELSE text END AS shown, CASE role WHEN 'neighbor' THEN 1200 ELSE 2800 END AS most FROM r),
b AS (SELECT query, place, concat({_HEADER}, chr(10), chr(10), 'SELECTED PAGE TEXT:', chr(10), CASE WHEN length(shown) > most THEN concat(substring(shown, 1, most), chr(10), '[...page text clipped...]') ELSE shown END, CASE WHEN NOT risky AND place = 0 THEN concat(chr(10), chr(10), 'CANONICAL PAGE TEXT:', chr(10), 'as printed') ELSE '' END) AS block FROM m),
p AS (SELECT query, {', '.join(f'max(block) FILTER (place = {k}) AS b{k}' for k in range(5))}, -64 AS u0 FROM b GROUP BY 1), {_STEPS}
SELECT query, CAST({' + '.join(f'CAST(k{k} AS INT)' for k in range(5))} AS INTEGER) AS blocks, CAST(greatest(u5, 0) AS INTEGER) AS n_chars, md5(array_to_string(list_filter([{', '.join(f'CASE WHEN k{k} THEN b{k} END' for k in range(5))}], lambda x: x IS NOT NULL), concat(chr(10), chr(10), repeat('=', 60), chr(10), chr(10)))) AS md5 FROM t4""")
def evidence_contexts(t):
    """Five documents a question, packed into {_BUDGET} characters."""
    none, kind = F.lit(None).cast("string"), F.col("doc_id") % 4
    place = (F.col("doc_id") % 5).cast("int")
    d = t("documents").where("doc_id is not null").select(
        F.floor(F.col("doc_id") / 5).alias("query"), place.alias("place"), F.concat(F.lit("S"), place).alias("label"), F.concat(F.lit("d"), "doc_id").alias("source_id"), F.col("doc_id").alias("page_number"),
        F.when(place == 4, "neighbor").alias("role"), none.alias("anchor_page"), F.when(F.col("lang") == "en", "IN").when(F.col("lang") == "de", "UP").otherwise(F.col("lang")).alias("jurisdiction_code"), F.lit("portal").alias("provider"),
        F.when(place % 2 == 0, "B").alias("tier"), none.alias("department"), none.alias("go_number"), none.alias("go_date"), F.lit("native").alias("variant"), F.lit(True).alias("canonical"), (kind == 1).alias("conflict"),
        F.when(kind == 0, "native_primary").when(kind == 1, "conflict").when(kind == 2, "variants_agree").otherwise("unverified").alias("verification"), F.when(place == 3, "superseded").otherwise("current").alias("status"),
        F.coalesce("text", F.lit("")).alias("selected_text"), F.when(place == 0, "as printed").otherwise(F.coalesce("text", F.lit(""))).alias("canonical_text"), none.alias("later_changes"),
    )
    found = C.evidence_context(d, [], _BUDGET)
    return found.select("query", "blocks", "n_chars", F.md5(F.col("context").cast("binary")).alias("md5"))


@query(f"""WITH {_LINES}, p AS (SELECT l_orderkey, part, min(l_linenumber) AS first, string_agg(concat(l_linenumber, '-', l_linenumber + 1), ', ' ORDER BY l_linenumber) AS ranges FROM x WHERE status = 'O' GROUP BY 1, 2)
SELECT l_orderkey AS volume, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS INTEGER) AS n, concat('https://books.example/', l_orderkey, '/', part, '.html') AS url, concat('Chapter of ', part, ' (paras ', ranges, ')') AS label FROM p""")
def handbook_chapters(t):
    """An index for each order: each line links its part's chapter by number, title and range of paragraphs; lines of status F link files of other kinds and folders."""
    page = F.concat("part", F.when(F.col("status") == "O", ".html").when(F.col("flag") == "R", ".doc").otherwise("/../../x.html"))
    a = lambda label: F.concat(F.lit("<li><a target=_blank href='"), page, F.lit("#top'>"), label, F.lit("</a>"))
    row = F.concat(a(F.lit("001")), a(F.concat(F.lit("<b>Chapter</b> of "), "part")), a(F.concat("l_linenumber", F.lit("-"), F.col("l_linenumber") + 1)))
    indexes = _pages(_lines(t), row, "<ol>", "</ol>").select(F.col("page_id").alias("volume"), F.concat(F.lit("https://books.example/"), "page_id", F.lit("/index.html")).alias("url"), "html")
    return C.handbook_index(indexes)


@query("""WITH r AS (SELECT l_orderkey AS volume, l_partkey AS a, l_partkey + l_linenumber - 1 AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY volume ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r),
i AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY volume ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m), s AS (SELECT volume, k, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2)
SELECT volume, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(a, '-', b) END, ', ' ORDER BY a) AS ranges FROM s GROUP BY 1""")
def paragraph_ranges(t):
    numbers = t("lineitem").select(F.col("l_orderkey").alias("volume"), F.col("l_partkey").alias("first"), (F.col("l_partkey") + F.col("l_linenumber") - 1).alias("last"))
    return C.compressed_ranges(numbers, "volume")


@query(f"""WITH {_LINES}, s AS (SELECT *, l_orderkey % 3 = 0 AS logits, flag = 'R' AS near, (part % 100) / 100.0::DOUBLE AS v FROM x), r AS (SELECT *, CASE WHEN NOT near THEN CASE WHEN logits THEN 1 / (1 + exp(-(v * 8 - 5))) ELSE v END END AS relevance FROM s),
k AS (SELECT *, bool_and(v * 8 - 5 BETWEEN 0 AND 1) FILTER (NOT near) OVER (PARTITION BY l_orderkey) AS mild FROM r), g AS (SELECT *, CASE WHEN logits AND mild AND NOT near THEN v * 8 - 5 ELSE relevance END AS rel FROM k)
SELECT g.l_orderkey AS query, g.l_linenumber AS page_number, coalesce(CASE WHEN g.near THEN a.rel >= 0.5 ELSE g.rel >= 0.5 END, false) AS kept, round(coalesce(max(g.rel) OVER (PARTITION BY g.l_orderkey), 0), 6) AS best FROM g LEFT JOIN g a ON a.l_orderkey = g.l_orderkey AND a.l_linenumber = g.l_linenumber - 1 AND NOT a.near""")
def relevance_anchors(t):
    """Lines of an order as pages: those of flag R are neighbours of the page before. Every third order has logits."""
    near, v = F.col("flag") == "R", (F.col("part") % 100) / 100.0
    e = _lines(t).select(F.col("l_orderkey").alias("query"), F.lit("d").alias("source_id"), F.col("l_linenumber").alias("page_number"), F.when(near, "neighbor").otherwise("direct").alias("role"), F.when(near, F.col("l_linenumber") - 1).alias("anchor_page"), F.when(F.col("l_orderkey") % 3 == 0, v * 8 - 5).otherwise(v).alias("score"))
    return E.relevant(e, 0.5).select("query", "page_number", "kept", F.round("best", 6).alias("best"))


@query(f"""WITH {_LINES}, w AS (SELECT part AS query, l_orderkey AS id, row_number() OVER (PARTITION BY part ORDER BY l_orderkey) AS place FROM (SELECT DISTINCT part, l_orderkey FROM x WHERE flag = 'A') y QUALIFY place <= 10),
s AS (SELECT part AS query, l_orderkey AS id, max((supp * 37 % 100) / 100.0::DOUBLE) AS similarity FROM x GROUP BY 1, 2), f AS (SELECT *, greatest(0.45::DOUBLE, max(similarity) OVER (PARTITION BY query) - 0.12::DOUBLE) AS floor FROM s),
b AS (SELECT query, id, 0 AS o, place::DOUBLE AS k, 'words' AS found FROM w UNION ALL SELECT f.query, f.id, 1, -similarity, 'similar' FROM f LEFT JOIN w ON w.query = f.query AND w.id = f.id WHERE similarity >= floor AND w.id IS NULL)
SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY o, k, id) AS INTEGER) AS place, found FROM b QUALIFY place <= 10""")
def filled_pages(t):
    """Orders of a part: lines of flag A are hits by words, the others are more or less alike."""
    x = _lines(t)
    place = F.row_number().over(Window.partitionBy("query").orderBy("id"))
    hits = x.where("flag = 'A'").select(F.col("part").alias("query"), F.col("l_orderkey").alias("id")).distinct().withColumn("place", place)
    similar = x.groupBy(F.col("part").alias("query"), F.col("l_orderkey").alias("id")).agg(F.max((F.col("supp") * 37 % 100) / 100.0).alias("similarity"))
    return E.filled_page(hits, similar)


@query("""WITH l AS (SELECT event_type AS listing, event_id AS number, user_id AS page, CAST(event_id % 50 AS BIGINT) AS rows_, CASE WHEN event_id % 5 = 0 THEN event_id END AS total, CASE WHEN event_id % 7 = 0 AND event_type <> 'click' THEN 20 + event_id % 3 END AS size, event_id % 11 = 0 AS reshuffle FROM events),
a AS (SELECT listing, count(DISTINCT page) FILTER (NOT reshuffle) AS pages, coalesce(sum(rows_) FILTER (NOT reshuffle), 0)::BIGINT AS rows, arg_max(total, number) FILTER (NOT reshuffle AND total IS NOT NULL) AS total, coalesce(arg_max(size, number) FILTER (NOT reshuffle AND size IS NOT NULL), 100)::BIGINT AS page_size, count(*) FILTER (reshuffle) AS reshuffles FROM l GROUP BY 1),
o AS (SELECT DISTINCT event_type AS listing, user_id FROM events), s AS (SELECT user_id, arg_max(CASE event_id % 4 WHEN 0 THEN 'stored' WHEN 1 THEN 'retry' WHEN 2 THEN 'unavailable' ELSE 'skipped' END, event_id) AS state FROM events WHERE user_id % 3 > 0 GROUP BY 1),
c AS (SELECT o.listing, count(*) AS orders, count(*) FILTER (state IN ('stored', 'skipped')) AS archived, count(*) FILTER (state = 'unavailable') AS unavailable, count(*) FILTER (state = 'retry') AS retry FROM o LEFT JOIN s ON s.user_id = o.user_id GROUP BY 1),
m AS (SELECT *, orders - archived - unavailable - retry AS waiting, CAST(ceil(total / page_size::DOUBLE) AS BIGINT) - pages AS missing_pages FROM a JOIN c USING (listing))
SELECT listing, pages, rows, total, page_size, reshuffles, orders, archived, unavailable, retry, waiting, missing_pages, CASE WHEN listing = 'view' THEN CASE WHEN total > orders THEN concat('complete, ', total - orders, ' orders fewer than the portal total (reshuffled/duplicate rows)') ELSE 'complete' END WHEN missing_pages <> 0 THEN concat(missing_pages, ' pages to capture') ELSE 'capture open' END AS state FROM m""")
def capture_reports(t):
    e = t("events")
    number = F.col("event_id")
    log = e.select(F.col("event_type").alias("listing"), number.alias("number"), F.col("user_id").alias("portal_page"), (number % 50).alias("rows"), F.when(number % 5 == 0, number).alias("total"), F.when((number % 7 == 0) & (F.col("event_type") != "click"), 20 + number % 3).alias("page_size"), (number % 11 == 0).alias("reshuffle"))
    inventory = e.select(F.col("event_type").alias("listing"), F.col("user_id").alias("source_id")).distinct()
    kind = F.when(number % 4 == 0, "stored").when(number % 4 == 1, "retry").when(number % 4 == 2, "unavailable").otherwise("skipped")
    statuses = e.where("user_id % 3 > 0").select(F.col("user_id").alias("source_id"), number.alias("number"), kind.alias("state"))
    found = E.capture_report(log, inventory, statuses, e.where("event_type = 'view'").select(F.col("event_type").alias("listing")))
    return found.withColumn("page_size", F.col("page_size").cast("long"))


_TOKENS = "list_sort(list_distinct(list_transform(regexp_extract_all(x, '[0-9][0-9.,:/()\\-]*'), lambda w: regexp_replace(w, '[.,;:]+$', ''))))"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, concat(CASE doc_id % 3 WHEN 0 THEN replace(coalesce(text, ''), '5', '8') ELSE coalesce(text, '') END, ' Rule ', doc_id % 7, '.') AS y FROM documents WHERE doc_id IS NOT NULL AND doc_id % 5 <> 4),
t AS (SELECT doc_id, {_TOKENS} AS n, {_TOKENS.replace('(x,', '(y,')} AS o FROM d)
SELECT doc_id AS source_id, array_to_string(list_sort(list_filter(n, lambda w: NOT list_contains(o, w))), ' ') AS native_only, array_to_string(list_sort(list_filter(o, lambda w: NOT list_contains(n, w))), ' ') AS ocr_only, len(list_filter(n, lambda w: NOT list_contains(o, w))) + len(list_filter(o, lambda w: NOT list_contains(n, w))) > 0 AS conflict FROM t""")
def numeric_disagreements(t):
    """Documents with a native text and an OCR text that misreads a digit in every third; of every fifth the OCR text is canonical, so nothing is compared."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    read = F.concat(F.when(i % 3 == 0, F.replace(text, F.lit("5"), F.lit("8"))).otherwise(text), F.lit(" Rule "), i % 7, F.lit("."))
    d = t("documents").where("doc_id is not null").select(i.alias("source_id"), F.explode(F.array(F.struct(F.lit("native").alias("variant_type"), text.alias("text")), F.struct(F.lit("ocr").alias("variant_type"), read.alias("text")))).alias("v"))
    v = d.select("source_id", F.lit(1).alias("page_number"), F.col("v.variant_type").alias("variant_id"), "v.variant_type", ((F.col("source_id") % 5 == 4) & (F.col("v.variant_type") == "ocr")).alias("canonical"), "v.text")
    return U.numeric_conflicts(v).select("source_id", F.array_join("native_only", " ").alias("native_only"), F.array_join("ocr_only", " ").alias("ocr_only"), "conflict")


@query("""WITH l AS (SELECT source, doc_id, length(coalesce(text, '')) AS n FROM documents WHERE source IS NOT NULL), q AS (SELECT source, list(n ORDER BY n) AS s, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(CASE WHEN n < 120 THEN 1 END) AS short, count(CASE WHEN n > 1900 THEN 1 END) AS long FROM l GROUP BY 1)
SELECT source, chunks, documents, s[1]::INTEGER AS shortest, s[1 + floor((chunks - 1) * 0.25)::BIGINT]::INTEGER AS p25, s[1 + floor((chunks - 1) * 0.5)::BIGINT]::INTEGER AS p50, s[1 + floor((chunks - 1) * 0.75)::BIGINT]::INTEGER AS p75, s[1 + floor((chunks - 1) * 0.95)::BIGINT]::INTEGER AS p95, s[chunks]::INTEGER AS longest, short, long FROM q""")
def length_reports(t):
    lengths = t("documents").where("source is not null").select("source", F.col("doc_id").alias("source_id"), F.lit(1).alias("page_number"), F.length(F.coalesce("text", F.lit(""))).alias("length"))
    return U.length_report(lengths, "source").select("source", "chunks", "documents", "shortest", "p25", "p50", "p75", "p95", "longest", "short", "long")


@query("""WITH p AS (SELECT l_orderkey AS source_id, CASE WHEN l_tax > 0.04 THEN 'ocr' ELSE 'native' END AS k, l_returnflag = 'R' AS legacy, octet_length(encode(concat('पृष्ठ ', l_partkey))) AS n FROM lineitem)
SELECT source_id, count(*) AS pages, CASE WHEN count(DISTINCT k) > 1 THEN 'mixed' ELSE min(k) END AS text_source, count(CASE WHEN legacy THEN 1 END) AS legacy_pages, CAST(sum(n) AS BIGINT) AS n_bytes FROM p GROUP BY 1""")
def extraction_reports(t):
    p = t("lineitem").select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_tax") > 0.04, "ocr").otherwise("native").alias("text_source"), (F.col("l_returnflag") == "R").alias("legacy"), F.concat(F.lit("पृष्ठ "), "l_partkey").alias("text"))
    return U.extraction_report(p)


@query("""WITH f AS (SELECT l_orderkey AS o, CASE WHEN l_orderkey % 4 = 0 THEN 'none' WHEN l_orderkey % 4 = 1 THEN 'A' WHEN l_orderkey % 4 = 2 THEN 'B' ELSE 'C' END AS tier, CASE l_returnflag WHEN 'R' THEN 'original' WHEN 'A' THEN 'image' ELSE 'other' END AS kind, l_partkey AS n, l_orderkey % 4 = 3 AND l_linenumber = 1 AS ev FROM lineitem),
o AS (SELECT tier, o, sum(n) FILTER (kind = 'original') AS a, sum(n) FILTER (kind = 'image') AS b, sum(n) FILTER (kind = 'other') AS c, bool_or(ev) AS ev FROM f GROUP BY 1, 2),
t AS (SELECT tier, count(*) AS orders, coalesce(sum(a), 0)::BIGINT AS original, coalesce(sum(b), 0)::BIGINT AS image, coalesce(sum(c), 0)::BIGINT AS other, count(CASE WHEN ev THEN 1 END) AS evicted FROM o GROUP BY 1)
SELECT *, orders - evicted AS kept, round((original + image + other)::DOUBLE / orders * orders / sum(orders) OVER () * 140000, 2) AS projected FROM t""")
def storage_reports(t):
    i = F.col("l_orderkey") % 4
    f = t("lineitem").select(F.col("l_orderkey").alias("source_id"), F.when(i == 1, "A").when(i == 2, "B").when(i == 3, "C").alias("tier"), F.when(F.col("l_returnflag") == "R", "original").when(F.col("l_returnflag") == "A", "image").otherwise("other").alias("kind"), F.col("l_partkey").alias("n_bytes"), ((i == 3) & (F.col("l_linenumber") == 1)).alias("evicted"))
    return U.storage_report(f, 140_000).withColumn("projected", F.round("projected", 2))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(CAST(l_shipdate AS DATE)) AS day FROM lineitem GROUP BY 1, 2), p AS (SELECT *, count(*) FILTER (flag <> 'R') OVER (PARTITION BY l_orderkey) AS n FROM x)
SELECT concat('cms-', l_orderkey, CASE WHEN n > 1 THEN CASE flag WHEN 'A' THEN concat('-pdf_', l_linenumber) ELSE '-hi' END ELSE '' END) AS source_id, concat('Post ', l_orderkey) AS title, concat('https://cms.gov/', l_orderkey, '-', l_linenumber, '.pdf') AS url,
CASE flag WHEN 'A' THEN '2001-02-03' ELSE strftime(day, '%Y-%m-%d') END AS go_date, CASE flag WHEN 'A' THEN 'unknown' ELSE 'hi' END AS language FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, CASE WHEN flag = 'A' THEN l_linenumber ELSE 0 END ORDER BY l_linenumber) AS k FROM p WHERE flag <> 'R') y WHERE flag = 'A' OR k = 1 OR n = 1""")
def cms_documents(t):
    """Orders as posts of a content system, lines as their files: Hindi ones with a date of their own, others without, and files on another host."""
    x = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min(F.to_date("l_shipdate")).alias("day"))
    file_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    host = F.when(F.col("flag") == "R", "https://example.org/").otherwise("https://cms.gov/")
    url = F.concat(F.lit('{"ID": 1, "url": "'), host, "l_orderkey", F.lit("-"), "l_linenumber", F.lit('.pdf"}'))
    plain = F.concat(F.lit('{"posts": {"acf_data": {"note": "x", "file_date": null, "language": ["Hindi", "English"], "pdf_'), "l_linenumber", F.lit('": '), url, F.lit("}}}"))
    hindi = F.concat(F.lit('{"posts": {"acf_data": {"pdf": '), url, F.lit(', "file_date": "'), F.date_format("day", "dd/MM/yyyy"), F.lit('", "language": ["Hindi"]}}}'))
    files = x.select(F.lit("cms").alias("site"), file_id.alias("file_id"), F.when(F.col("flag") == "A", plain).otherwise(hindi).alias("body"))
    held = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(file_id)).alias("ids"))
    listing = F.concat(F.lit('{"total_pages": 1, "posts": [{"ID": '), "l_orderkey", F.lit(', "post_title": " Post '), "l_orderkey", F.lit(' ", "acf_data": {"date": "03/02/2001", "file": [{"file": ['), F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("]}]}}]}"))
    answers = held.select(F.col("l_orderkey").alias("place"), F.lit("cms").alias("site"), listing.alias("body"))
    return listings.attachments(cms.cms_posts(answers, files), ["cms.gov"])

"""Questions for orders, as queries: their parse on templates that every document fills with its own words, numbers and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as D
from ..operators import finder
from ..operators import procurement as P
from ..operators import salvage as S
from ..operators.search import cover_ranks
from .registry import query

TODAY = "2026-09-27"
STOP = ["the", "and", "of", "to", "in", "is", "which", "what"]
# What questions may name: departments with their names.
REGISTRY = [
    (34, "Public Works"), (34, "PWD"), (34, "लोक निर्माण विभाग"), (37, "Agriculture"), (37, "कृषि विभाग"), (162, "Finance"), (162, "वित्त विभाग"), (40, "Home"), (40, "गृह विभाग"), (50001, "Basic Education"),
]
#: {a} and {b} are words of the document, {n} a number under 900, {y} a year, {d} and {m} a day under 29 and a month, {x} and {z} the day and month with two digits.
TEMPLATES = [
    "recent orders of Basic Education", "find GO {n}/{y}/{d}", "search \"{a} {b}\"", "{a}* orders of agriculture", "orders about {a} {b}", "orders released by कृषि अनुभाग-{d} this week",
    "orders issued by {a} {b}", "orders dated {x}.{z}.{y} or 28.12.2025", "what does the latest order say about {a}", "Finance, {x}.{z}.{y}", "is there any order on {a} from home?",
    "GeM guidelines of the central government on {a}", "शासनादेश संख्या {n} / {y}", "circulars of PWD since {x}/{z}/{y}", "{a} {b} and nothing else",
]
_PARTS = {
    "a": "concat('zy', regexp_extract(lower(coalesce(text, '')), '([a-z]{4,9})', 1))", "b": "concat('qu', regexp_extract(lower(coalesce(text, '')), ' ([a-z]{3,8})', 1))",
    "n": "CAST(1 + doc_id % 899 AS STRING)", "y": "CAST(2020 + doc_id % 6 AS STRING)", "d": "CAST(1 + doc_id % 28 AS STRING)", "m": "CAST(1 + doc_id % 12 AS STRING)",
    "x": "lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')", "z": "lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0')",
}


def _filled():
    out = f"CASE CAST(doc_id % {len(TEMPLATES)} AS INT)"
    for k, template in enumerate(TEMPLATES):
        filled = "'" + template.replace("'", "''") + "'"
        for name in _PARTS:
            filled = f"replace({filled}, '{{{name}}}', {name})" if f"{{{name}}}" in template else filled
        out += f" WHEN {k} THEN {filled}"
    return out + " END"


def questions(t):
    docs = t("documents").where("doc_id is not null").selectExpr("doc_id", *[f"{e} AS {n}" for n, e in _PARTS.items()])
    return docs.selectExpr("doc_id AS query", f"{_filled()} AS question")


_ROWS = f"q AS (SELECT doc_id AS query, doc_id % {len(TEMPLATES)} AS k, {', '.join(f'{e} AS {n}' for n, e in _PARTS.items())} FROM documents WHERE doc_id IS NOT NULL), day AS (SELECT query, make_date(CAST(y AS BIGINT), CAST(m AS BIGINT), CAST(d AS BIGINT)) AS day FROM q)"


@query(f"""WITH {_ROWS} SELECT q.query, CASE WHEN k IN (0, 7, 9, 13) THEN 'recent' ELSE 'find' END AS mode, k IN (1, 2, 3, 5, 6, 12) AS explicit,
CASE k WHEN 0 THEN 50001 WHEN 3 THEN 37 WHEN 5 THEN 37 WHEN 9 THEN 162 WHEN 13 THEN 34 ELSE -1 END AS department, CASE k WHEN 1 THEN concat(n, '/', y, '/', d) WHEN 12 THEN concat(n, '/', y) END AS go_number,
CASE WHEN k = 2 THEN concat(a, ' ', b) ELSE '' END AS phrases, CASE WHEN k = 3 THEN concat(a, '*') ELSE '' END AS patterns, CASE WHEN k = 5 THEN concat('कृषि अनुभाग ', d) END AS section, CASE WHEN k = 6 THEN concat(a, ' ', b) END AS person,
CASE WHEN k = 11 THEN 'IN' ELSE '' END AS jurisdictions, CASE WHEN k = 11 THEN 'gem' ELSE '' END AS topics, CASE k WHEN 4 THEN concat(a, ' ', b) WHEN 10 THEN concat(a, ' home') WHEN 11 THEN a ELSE '' END AS words,
CASE k WHEN 12 THEN concat(y, '-01-01') WHEN 5 THEN '2026-09-21' WHEN 7 THEN strftime(least(day, DATE '2025-12-28'), '%Y-%m-%d') WHEN 9 THEN strftime(day, '%Y-%m-%d') WHEN 13 THEN strftime(day, '%Y-%m-%d') END AS date_from,
CASE k WHEN 12 THEN concat(y, '-12-31') WHEN 5 THEN '{TODAY}' WHEN 7 THEN strftime(greatest(day, DATE '2025-12-28'), '%Y-%m-%d') WHEN 9 THEN strftime(day, '%Y-%m-%d') WHEN 13 THEN '{TODAY}' END AS date_to,
CASE WHEN k = 7 AND day <> DATE '2025-12-28' THEN 2 ELSE 0 END AS dates, CASE k WHEN 2 THEN concat(a, ' ', b) WHEN 3 THEN CASE WHEN length(a) >= 3 THEN a END WHEN 4 THEN concat(a, ' ', b) WHEN 10 THEN concat(a, ' home') WHEN 11 THEN a END AS similar
FROM q JOIN day ON q.query = day.query WHERE k NOT IN (8, 14)""")
def parsed_questions(t):
    registry = t("nation").sparkSession.createDataFrame(REGISTRY, "entry int, phrase string")
    found = finder.parse(questions(t), registry, TODAY)
    joined = [F.array_join(c, " ").alias(c) for c in ("phrases", "patterns", "jurisdictions", "topics", "words")]
    days = [F.col(c).cast("string").alias(c) for c in ("date_from", "date_to")]
    return found.select("query", "mode", "explicit", F.coalesce("department", F.lit(-1)).alias("department"), "go_number", *joined, "section", "person", *days, F.size("dates").alias("dates"), "similar")


def _covers(least: str) -> str:
    """Over positions: for each place the last ones of all terms of its text, the least-th of which begins the stretch."""
    return rf"""WITH q AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-zऀ-ॣ०-ॿ]+') AS ws FROM benchmark WHERE item_id % 20 = 0)),
f AS (SELECT item_id, w, min(i) AS i FROM q WHERE length(w) >= 2 AND w NOT IN ({', '.join(f"'{s}'" for s in STOP)}) GROUP BY item_id, w),
t AS (SELECT item_id, w, count(*) OVER (PARTITION BY item_id) AS size FROM (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM f) WHERE n <= 12),
d AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS ws FROM documents)),
p AS (SELECT item_id, doc_id, n, pos, w, size FROM d JOIN t USING (w)),
l AS (SELECT p.*, max(CASE WHEN p.w = t.w THEN pos END) OVER (PARTITION BY p.item_id, doc_id, t.w ORDER BY pos) AS last FROM p JOIN t ON p.item_id = t.item_id),
b AS (SELECT item_id, doc_id, n, pos, list(last ORDER BY last DESC) FILTER (last IS NOT NULL) AS lasts, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS k, any_value(size) AS size FROM l GROUP BY item_id, doc_id, n, pos),
s AS (SELECT *, coalesce(lasts[{least}], 0) AS start_pos FROM b),
c AS (SELECT *, lag(start_pos, 1, 0) OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS before FROM s),
h AS (SELECT c.*, o.k AS first FROM c JOIN b o ON c.item_id = o.item_id AND c.doc_id = o.doc_id AND o.pos = c.start_pos WHERE start_pos > before),
r AS (SELECT item_id, doc_id, round(sum(0.1::DOUBLE / (1 + (pos - start_pos) - (k - first))) / (1 + ln(n)), 6) AS score FROM h GROUP BY item_id, doc_id, n)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) x WHERE rank <= 10"""


def _ranked(t, least):
    """Queries are the items whose id is divisible by 20, against all documents."""
    return cover_ranks(t("documents"), "doc_id", "text", t("benchmark").where("item_id % 20 = 0"), "item_id", "text", STOP, least)


@query(_covers("1"))
def cover_rank_any(t):
    return _ranked(t, 1)


@query(_covers("3"))
def cover_rank_three(t):
    return _ranked(t, 3)



# Answers of the orders: each line of an order is a sentence about its supplier, part and quantity; flags and numbers decide what is wrong with it.
_SAID = "concat('Supplier ', CASE WHEN l_tax > 0.04 THEN 'delivers' ELSE 'promises' END, ' goods without quotation up to ', CAST(CAST(l_quantity AS INT) AS STRING), ' units')"
_SENTENCES = f"""x AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS INT) AS q, {_SAID} AS said,
CASE WHEN l_quantity > 40 THEN '' WHEN l_returnflag = 'R' THEN concat(' [S', l_linenumber + 10, ' p.', l_linenumber, ']') ELSE concat(' [S', l_linenumber, ' p.', l_linenumber, ']') END AS cite, l_returnflag = 'A' AS wrong, l_linestatus = 'F' AS other FROM
(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2) l)"""


def _order_answers(t):
    """Answers and their pages. Page n prints the number of line n; where the flag is A it prints another one, so the citation is wrong; flag R cites a
    page that is not there; quantities above 40 have no citation. Page 90 + n prints the number of line n where the line's status is F."""
    # by order at once: lines, answers, pages and all that follows keep this division
    t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_tax").repartition("l_orderkey").createOrReplaceTempView("lineitem")
    x = t("lineitem").sparkSession.sql(f"WITH {_SENTENCES} SELECT * FROM x")
    line = F.struct("l_linenumber", F.concat(F.lit("- "), "said", "cite", F.lit(".")).alias("s"))
    answers = x.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda v: v["s"]), "\n").alias("text"))
    own = F.struct(F.concat(F.lit("S"), "l_linenumber").alias("label"), F.col("l_linenumber").cast("int").alias("page"), F.array(F.concat(F.lit("goods: "), (F.col("q") + F.when(F.col("wrong"), 1000).otherwise(0)).cast("string"))).alias("texts"))
    also = F.struct(F.concat(F.lit("S"), F.col("l_linenumber") + 20).alias("label"), (F.col("l_linenumber") + 90).cast("int").alias("page"), F.array(F.concat(F.lit("without quotation for goods up to "), "q", F.lit(" units"))).alias("texts"))
    each = x.select("l_orderkey", F.inline(F.array_compact(F.array(own, F.when(F.col("other"), also)))))
    return answers, each.withColumn("risky", F.lit(False))



_OK = "cite <> '' AND l_returnflag <> 'R' AND NOT wrong"


@query(f"""WITH {_SENTENCES}, k AS (SELECT l_orderkey, count(*) AS sentences, count(CASE WHEN {_OK} THEN 1 END) AS kept, string_agg(CASE WHEN {_OK} THEN concat('• ', said, cite, '.') END, chr(10) ORDER BY l_linenumber) AS lines, any_value(CASE WHEN {_OK} THEN concat(said, cite, '.') END) AS one FROM x GROUP BY 1)
SELECT l_orderkey, CAST(kept AS INTEGER) AS kept, sentences, CASE WHEN kept = 0 OR kept < ceil(sentences * 0.3) THEN '' WHEN kept = 1 THEN one ELSE lines END AS salvaged FROM k""")
def salvaged_answers(t):
    answers, evidence = _order_answers(t)
    return S.salvage(answers, "l_orderkey", "text", evidence)


@query(f"""WITH {_SENTENCES}, p AS (SELECT l_orderkey, l_linenumber + 20 AS label, l_linenumber + 90 AS page, q FROM x WHERE other),
b AS (SELECT x.l_orderkey, x.l_linenumber, arg_min({{'l': p.label, 'p': p.page}}, p.label) AS best FROM x JOIN p ON x.l_orderkey = p.l_orderkey AND x.q = p.q WHERE cite = '' OR wrong AND l_returnflag <> 'R' GROUP BY 1, 2),
f AS (SELECT x.*, CASE WHEN best IS NOT NULL THEN concat(' [S', best.l, ' p.', best.p, ']') ELSE '' END AS more FROM x LEFT JOIN b ON x.l_orderkey = b.l_orderkey AND x.l_linenumber = b.l_linenumber)
SELECT l_orderkey, string_agg(concat('- ', said, cite, more, '.'), chr(10) ORDER BY l_linenumber) AS answer, CAST(count(CASE WHEN more <> '' THEN 1 END) AS INTEGER) AS added FROM f GROUP BY 1""")
def cited_answers(t):
    answers, evidence = _order_answers(t)
    return S.add_citations(answers, "l_orderkey", "text", evidence)


_BOOK_WORDS = ["gem gtc rules", "GFR 2017", "the DFPR", "works manual", "non-consultancy manual", "consultancy manual", "UP procurement manual", "goods manual", "goods manual 2016", "nothing"]
_BOOK_TEXT = "concat('What does ', [" + ", ".join(f"'{w}'" for w in _BOOK_WORDS) + f"][1 + CAST(doc_id % {len(_BOOK_WORDS)} AS INT)], ' say of ', regexp_extract(lower(coalesce(text, '')), '([a-z]+ [a-z]+)', 1), CASE WHEN doc_id % 3 = 0 THEN ' in a tender' WHEN doc_id % 3 = 1 THEN ' and GFR' ELSE '' END)"


def _re2(name: str) -> str:
    pattern, unless = next((p, u) for n, p, u in P.BOOKS if n == name)
    hit = lambda p: f"regexp_matches(q, '(?i){p}')"
    return f"CASE WHEN {hit(pattern)}{f' AND NOT {hit(unless)}' if unless else ''} THEN '{name}' END"


@query(f"""WITH t AS (SELECT doc_id, {_BOOK_TEXT} AS q FROM documents) SELECT doc_id, array_to_string(list_filter([{', '.join(_re2(n) for n, _, _ in P.BOOKS)}], lambda x: x IS NOT NULL), '; ') AS books, regexp_matches(q, '(?i){P.BUYING}') AS buying, regexp_matches(q, '(?i){P.GEM}') AS gem FROM t""")
def named_rulebooks(t):
    """Questions that name books, with words of every document."""
    words = F.get(F.array(*map(F.lit, _BOOK_WORDS)), (F.col("doc_id") % len(_BOOK_WORDS)).cast("int"))
    about = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "([a-z]+ [a-z]+)", 1)
    third = F.col("doc_id") % 3
    asked = t("documents").select("doc_id", F.concat(F.lit("What does "), words, F.lit(" say of "), about, F.when(third == 0, " in a tender").when(third == 1, " and GFR").otherwise("")).alias("q"))
    return asked.select("doc_id", F.array_join(P.named_books(F.col("q")), "; ").alias("books"), P.is_buying(F.col("q")).alias("buying"), (F.size(P.books_to_check(F.col("q"))) == 2).alias("gem"))


@query("""WITH x AS (SELECT l_orderkey AS query, l_linenumber AS place, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, CASE WHEN s % 4 = 0 THEN 9 ELSE s % 4 END AS rank, min(place) OVER (PARTITION BY query, s) AS first FROM x)
SELECT query, concat('S', row_number() OVER (PARTITION BY query ORDER BY rank, first, place)) AS label, concat('book-', s) AS source_id, place AS page_number FROM r""")
def authority_order(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("place")).agg(F.min("l_suppkey").alias("s"))
    evidence = lines.select("query", "place", F.concat(F.lit("book-"), "s").alias("source_id"), F.col("place").alias("page_number"))
    ranks = t("supplier").where("s_suppkey % 4 > 0").select(F.concat(F.lit("book-"), "s_suppkey").alias("source_id"), (F.col("s_suppkey") % 4).alias("rank"))
    return P.by_authority(evidence, ranks)


_LEANS = " OR ".join("regexp_matches(question, '" + p.replace("'", "''") + "')" for p in D.FOLLOW_UP)


@query(f"""WITH t AS (SELECT conv_id, turn, CASE turn % 6 WHEN 2 THEN concat('And what of ', coalesce(text, '')) WHEN 4 THEN concat(coalesce(text, ''), ' under that rule?') ELSE trim(coalesce(text, '')) END AS q0 FROM conversations WHERE role = 'user'),
u AS (SELECT conv_id, turn, trim(q0, ' ') AS question, trim(regexp_replace(q0, '\\s+', ' ', 'g')) AS l FROM t), c AS (SELECT *, nullif(CASE WHEN length(l) > 500 THEN concat(rtrim(substring(l, 1, 500)), '…') ELSE l END, '') AS c FROM u),
b AS (SELECT *, lag(c, 1 IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lag(c, 2 IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM c),
f AS (SELECT *, b IS NOT NULL AND ({_LEANS}) AS contextualized FROM b)
SELECT conv_id, turn, contextualized, CASE WHEN contextualized THEN concat('Current question: ', question, chr(10), CASE WHEN a IS NOT NULL THEN concat('Previous user question 1: ', a, chr(10), 'Previous user question 2: ', b) ELSE concat('Previous user question 1: ', b) END) ELSE question END AS retrieval_query FROM f""")
def contextual_questions(t):
    """Turns of conversations, some of which point back to what was asked before."""
    text, k = F.coalesce("text", F.lit("")), F.col("turn") % 6
    asked = F.when(k == 2, F.concat(F.lit("And what of "), text)).when(k == 4, F.concat(text, F.lit(" under that rule?"))).otherwise(text)
    return D.contextual_questions(t("conversations").withColumn("text", asked)).select("conv_id", "turn", "contextualized", "retrieval_query")

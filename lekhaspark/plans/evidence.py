"""Chunks, references between orders and answer checks. Where no table has such texts, Spark makes them of its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunks import chunks
from ..functions.questions import date_range
from ..functions.references import order_references, resolved
from ..operators import answers as A
from ..operators.search import keyword_hits
from .registry import query


@query()
def chunk_documents(t):
    """Sequential breaks: no SQL; tests compare with a plain walk."""
    return chunks(t("documents"), "doc_id", "text").select("doc_id", "chunk_index", "chars", "sha256")


def _notices(t):
    """One text for each order line that mentions two orders, with relation words after them."""
    day = F.date_format("l_shipdate", "dd.MM.yyyy")
    words = F.when(F.col("l_returnflag") == "R", " is cancelled.").when(F.col("l_returnflag") == "A", " is amended.").otherwise(" is in force.")
    text = F.concat(F.lit("Order No. "), F.col("l_partkey"), F.lit("/"), F.year("l_shipdate"), F.lit("/7, dated "), day, words, F.lit(" For the older text see the file of the same office under No. "), F.col("l_suppkey"), F.lit("/2001/1 dated 5 March 2001."))
    return t("lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("line"), text.alias("text"))


_REFERENCES = """WITH r AS (SELECT l_orderkey, l_linenumber, concat(l_partkey, '/', year(l_shipdate)) AS go_key, CAST(l_shipdate AS DATE) AS go_date, CASE l_returnflag WHEN 'R' THEN 'cancels' WHEN 'A' THEN 'amends' ELSE 'refers' END AS kind FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, concat(l_suppkey, '/2001'), DATE '2001-03-05', 'refers' FROM lineitem)"""


@query(f"{_REFERENCES} SELECT l_orderkey, l_linenumber, go_key, CAST(go_date AS STRING) AS go_date, CASE max(CASE kind WHEN 'cancels' THEN 3 WHEN 'amends' THEN 2 ELSE 0 END) WHEN 3 THEN 'cancels' WHEN 2 THEN 'amends' ELSE 'refers' END AS kind FROM r GROUP BY ALL")
def notice_references(t):
    found = order_references(_notices(t), "line", "text", evidence=False)
    return found.select("line.l_orderkey", "line.l_linenumber", "go_key", F.col("go_date").cast("string").alias("go_date"), "kind")


@query("""WITH k AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN k.n = 1 AND k.lo <> l.l_orderkey THEN lo WHEN k.n = 2 AND lo = l.l_orderkey THEN hi WHEN k.n = 2 AND hi = l.l_orderkey THEN lo ELSE -1 END AS target
FROM lineitem l LEFT JOIN k ON l.l_suppkey = k.o_custkey AND CAST(l.l_shipdate AS DATE) = k.d""")
def resolved_references(t):
    key = lambda n, d: F.concat_ws("/", n, F.year(d))
    refs = t("lineitem").select("l_orderkey", "l_linenumber", key("l_suppkey", "l_shipdate").alias("go_key"), F.to_date("l_shipdate").alias("go_date"))
    orders = t("orders").select("o_orderkey", key("o_custkey", "o_orderdate").alias("go_key"), F.to_date("o_orderdate").alias("go_date"))
    return resolved(refs, "l_orderkey", orders, "o_orderkey").select("l_orderkey", "l_linenumber", F.coalesce("target", F.lit(-1)).alias("target"))


def _lines(t):
    """One row for each order and line number."""
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_returnflag", "l_linestatus")])


_LINES = "WITH x AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"


def _answers(t):
    """One answer for each order: a line for each order line; lines over 40 are uncited, line 3 states a number of its own."""
    q = F.col("l_quantity").cast("int").cast("string")
    cite = F.concat(F.lit(" [S"), F.col("l_linenumber"), F.lit(" p."), F.col("l_linenumber"), F.lit("]"))
    line = F.concat(F.col("l_linenumber"), F.lit(". The limit is "), q, F.when(F.col("l_linenumber") == 3, F.lit(" or 9,999")).otherwise(""), F.when(F.col("l_quantity") > 40, "").otherwise(cite), F.lit("."))
    lines = _lines(t).select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), line.alias("x")).alias("s"), F.struct(F.concat(F.lit("S"), "l_linenumber").alias("label"), F.col("l_linenumber").alias("page"), F.array(F.concat(F.lit("limit "), q), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("read as "), q))).alias("texts"), (F.col("l_returnflag") == "R").alias("risky")).alias("e"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s.x), "\n")
    return lines.groupBy("l_orderkey").agg(text.alias("text")), lines.select("l_orderkey", "e.*")


@query(f"""{_LINES}, q AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS unit, CASE WHEN l_quantity > 40 THEN 'uncited' WHEN l_returnflag = 'R' AND (l_linestatus <> 'O' OR l_linenumber = 3) THEN 'unsafe' WHEN l_linenumber = 3 THEN 'unsupported' END AS issue FROM x)
SELECT * FROM q WHERE issue IS NOT NULL""")
def answer_numeric_issues(t):
    texts, evidence = _answers(t)
    return A.numeric_issues(A.claim_units(texts, "l_orderkey", "text"), "l_orderkey", evidence)


@query(f"""{_LINES}, q AS (SELECT l_orderkey, CASE WHEN l_quantity > 40 THEN 'uncited' WHEN l_returnflag = 'R' AND (l_linestatus <> 'O' OR l_linenumber = 3) THEN 'unsafe' WHEN l_linenumber = 3 THEN 'unsupported' END AS code FROM x
UNION ALL SELECT l_orderkey, CASE WHEN min(l_quantity) > 40 THEN 'missing_citation' END FROM x GROUP BY 1)
SELECT l_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS issues, count(code) = 0 AS ok FROM q GROUP BY 1""")
def answer_validation(t):
    texts, evidence = _answers(t)
    return A.validate(texts, "l_orderkey", "text", evidence).withColumn("issues", F.array_join("issues", ","))


@query(f"{_LINES} SELECT l_orderkey, concat('S', l_linenumber) AS label, l_linenumber AS page FROM x WHERE l_quantity <= 40 AND l_returnflag = 'A'")
def answer_invalid_citations(t):
    texts, _ = _answers(t)
    held = _lines(t).where("l_returnflag <> 'A'").select("l_orderkey", F.concat(F.lit("S"), "l_linenumber").alias("label"), F.col("l_linenumber").alias("page"))
    return A.invalid_citations(A.claim_units(texts, "l_orderkey", "text"), "l_orderkey", held)


@query("SELECT doc_id, sha256(CASE WHEN lang = 'en' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9०-९]+([.,:/-][0-9०-९]+)*(\\s*%)?', '', 'g'), '\\s+%', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') ELSE text END) AS sha FROM documents")
def masked_evidence(t):
    return t("documents").select("doc_id", F.sha2(A.masked_numbers(F.col("text"), F.col("lang") == "en"), 256).alias("sha"))


STOP = ["the", "and", "of", "to", "in", "is", "which", "what"]


@query(r"""WITH q AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-zऀ-ॣ०-ॿ]+') AS ws FROM benchmark)),
f AS (SELECT item_id, w, min(i) AS i FROM q WHERE length(w) >= 2 AND w NOT IN ('the', 'and', 'of', 'to', 'in', 'is', 'which', 'what') GROUP BY item_id, w),
t AS (SELECT item_id, w FROM (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM f) WHERE n <= 12),
d AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS ws FROM documents)),
c AS (SELECT doc_id, n, w, count(*) AS tf FROM d GROUP BY doc_id, n, w), s AS (SELECT item_id, doc_id, round(sum(ln(1 + tf)) / (1 + ln(n)), 6) AS score FROM c JOIN t USING (w) GROUP BY item_id, doc_id, n)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 10""".replace("\\\\", "\\"))
def keyword_topk(t):
    """A report: the ten best documents of each benchmark item."""
    return keyword_hits(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text", STOP).select("item_id", "doc_id", "score")


@query("""WITH e AS (SELECT event_id, ts::DATE AS d, user_id, event_type FROM events),
r AS (SELECT event_id, CASE event_type WHEN 'click' THEN d - (user_id % 40)::INT WHEN 'view' THEN date_trunc('week', d)::DATE - 7 WHEN 'error' THEN date_trunc('month', d)::DATE WHEN 'purchase' THEN d - 1 ELSE DATE '2023-03-05' END AS a,
CASE event_type WHEN 'view' THEN date_trunc('week', d)::DATE - 1 WHEN 'purchase' THEN d - 1 ELSE d END AS b FROM e)
SELECT event_id, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day FROM r""")
def question_date_range(t):
    """Questions made of the events: a range of days, weeks, months or since a date, seen from the day of the event."""
    kind = F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit("orders of the last "), F.col("user_id") % 40 + 1, F.lit(" days"))).when(kind == "view", "what came last week")
    text = text.when(kind == "error", "all of this month").when(kind == "purchase", "yesterday").otherwise("changes since 5th March 2023, please")
    found = date_range(text, F.to_date("ts"))
    return t("events").select("event_id", found["from"].cast("string").alias("first_day"), found["to"].cast("string").alias("last_day"))

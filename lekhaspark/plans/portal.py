"""Questions against registries, keyword mining and portal listings as queries over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, listings, matching, mining, records
from .registry import query

# What questions may name, as small tables: phrases of departments, playbooks with triggers, contexts and boosts.
REGISTRY = [(1, "agriculture"), (1, "कृषि विभाग"), (2, "basic education"), (2, "education"), (3, "home"), (4, "home guards")]
TRIGGERS = [(1, "solar pump"), (1, "subsidy"), (2, "subsidy"), (2, "rate of subsidy"), (3, "transfer")]
CONTEXTS = [(2, "farmer"), (2, "kisan")]
BOOSTS = [(1, 0, 1), (2, 1, 2), (3, 0, 3)]
QUESTIONS = [
    "Orders of the Basic Education department", "what does agriculture say", "कृषि विभाग के आदेश", "home guards and home", "Is HOME department open?", "nothing of the kind",
    "rate of subsidy on a solar-pump", "rate of subsidy for a farmer", "subsidy for kisan solar pump", "audit of GeM purchase rules, audit again", "पेंशन and RTI", "transfer, subsidy",
]


#: A question for each document: one of the above, and words of the document.
_Q = "concat([" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + f"][1 + CAST(doc_id % {len(QUESTIONS)} AS INT)], ' / ', regexp_extract(coalesce(text, ''), '([A-Za-z]+ [A-Za-z]+ [A-Za-z]+)', 1))"


def questions(t):
    """One question for each document, with words of its own."""
    asked = F.get(F.array(*map(F.lit, QUESTIONS)), (F.col("doc_id") % len(QUESTIONS)).cast("int"))
    words = F.regexp_extract(F.coalesce("text", F.lit("")), "([A-Za-z]+ [A-Za-z]+ [A-Za-z]+)", 1)
    return t("documents").where("doc_id is not null").select(F.col("doc_id").alias("query"), F.concat(asked, F.lit(" / "), words).alias("question"))


def _values(rows, names):
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"


_QUESTIONS = f"q AS (SELECT doc_id AS query, concat(' ', trim(regexp_replace(lower({_Q}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')), ' ') AS x FROM documents WHERE doc_id IS NOT NULL)"


def _hits(name: str, rows) -> str:
    return f"{name} AS (SELECT query, entry, phrase, length(phrase) AS n, len(string_split(phrase, ' ')) AS words, substring(x, instr(x, concat(' ', phrase, ' ')) + length(phrase) + 2) AS rest FROM q, {_values(rows, ['entry', 'phrase'])} WHERE contains(x, concat(' ', phrase, ' ')))"


@query(f"""WITH {_QUESTIONS}, {_hits('h', REGISTRY)}, s AS (SELECT *, words >= 2 OR regexp_matches(phrase, '(विभाग|department)$') OR regexp_matches(rest, '^(विभाग|department|dept)( |$)') AS strong FROM h)
SELECT query, entry, phrase, strong FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, strong DESC, entry, phrase) AS k FROM s) x WHERE k = 1""")
def department_mentions(t):
    registry = t("nation").sparkSession.createDataFrame(REGISTRY, "entry int, phrase string")
    return matching.department_mentions(questions(t), registry)


@query(f"""WITH {_QUESTIONS}, {_hits('h', TRIGGERS)}, {_hits('c', CONTEXTS)}, b AS (SELECT * FROM {_values(BOOSTS, ['entry', 'boost', 'place'])}),
s AS (SELECT query, entry, sum(words) AS w FROM h GROUP BY 1, 2), g AS (SELECT s.*, w + boost AS score, place FROM s JOIN b USING (entry) WHERE entry <> 2 OR EXISTS (SELECT 1 FROM c WHERE c.query = s.query AND c.entry = s.entry))
SELECT query, entry, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS k FROM g) x WHERE k = 1""")
def playbook_match(t):
    spark = t("nation").sparkSession
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((TRIGGERS, "entry int, phrase string"), (CONTEXTS, "entry int, phrase string"), (BOOSTS, "entry int, boost int, place int"))]
    return matching.playbooks(questions(t), *tables)


_TOPIC_SQL = [(code, "'(?i)" + p.replace("'", "''") + "'") for code, p in matching.QUERY_TOPICS]


@query(f"""WITH q AS (SELECT doc_id AS query, {_Q} AS q FROM documents WHERE doc_id IS NOT NULL)
SELECT query, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(q, {p}) THEN '{c}' END" for c, p in _TOPIC_SQL)}], lambda x: x IS NOT NULL), ',') AS topics,
array_to_string(flatten([{', '.join(f'regexp_extract_all(q, {p})' for _, p in _TOPIC_SQL)}]), ',') AS matched FROM q""")
def question_topics(t):
    found = questions(t).select("query", matching.query_topics(F.col("question")).alias("t"))
    return found.select("query", F.array_join("t.topics", ",").alias("topics"), F.array_join("t.matched", ",").alias("matched"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('  ', w, ' '), i, 3))))) AS g FROM part),
a AS (SELECT g FROM w WHERE p_partkey = 0) SELECT p_partkey, round(len(list_intersect(w.g, a.g)) / len(list_distinct(list_concat(w.g, a.g))), 6) AS similarity FROM w, a""")
def trigram_similarity(t):
    p = t("part").select("p_partkey", "p_name")
    first = p.where("p_partkey = 0").select(F.col("p_name").alias("first"))
    return p.join(F.broadcast(first)).select("p_partkey", F.round(matching.similarity(F.col("p_name"), F.col("first")), 6).alias("similarity"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('  ', w, ' '), i, 3))))) AS g FROM part),
s AS (SELECT a.p_partkey AS query, w.p_partkey, round(len(list_intersect(w.g, a.g)) / len(list_distinct(list_concat(w.g, a.g))), 6) AS similarity FROM w JOIN w a ON a.p_partkey % 20 = 0)
SELECT query, p_partkey, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, p_partkey) AS rank FROM s WHERE similarity > 0) x WHERE rank <= 10""")
def similar_names(t):
    """Queries are the parts whose key is divisible by 20, against all parts."""
    p = t("part").select("p_partkey", "p_name")
    return matching.similar_names(p, p.where("p_partkey % 20 = 0"), "p_partkey", "p_name")


@query(r"""WITH c AS (SELECT page, term, count(*) AS tf FROM (SELECT doc_id AS page, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')) AS term FROM documents) x GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), r AS (SELECT page, c.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN d ON c.term = d.term, n WHERE df >= 2 AND df <= 0.3 * n),
m AS (SELECT page, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1), q AS (SELECT query, term, 1 + ln(count(*)) AS q FROM (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')) AS term FROM benchmark WHERE item_id % 20 = 0) x GROUP BY 1, 2),
s AS (SELECT query, r.page, round(sum(q * w / norm), 9) AS score FROM q JOIN r ON q.term = r.term JOIN m ON m.page = r.page GROUP BY 1, 2) SELECT query, page, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, page) AS place FROM s) x WHERE place <= 10""")
def tfidf_candidates(t):
    """Queries are the items whose id is divisible by 20, against all documents."""
    asked = t("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    return mining.keyword_candidates(asked, t("documents").select(F.col("doc_id").alias("page"), "text"), 10).select("query", "page", "place")


def _scored(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("page")).agg(F.max("l_extendedprice").alias("score"), F.bool_or(F.col("l_linenumber") == 1).alias("positive"))


_SCORED = "c AS (SELECT l_orderkey AS query, l_partkey AS page, max(l_extendedprice) AS score, bool_or(l_linenumber = 1) AS positive FROM lineitem GROUP BY 1, 2), p AS (SELECT query, max(score) AS ps FROM c WHERE positive GROUP BY 1)"
_RANKS = "k AS (SELECT p.query, p.ps, 1 + count(CASE WHEN NOT c.positive AND c.score > p.ps THEN 1 END) AS rank FROM p JOIN c ON c.query = p.query GROUP BY 1, 2)"


@query(f"WITH {_SCORED}, {_RANKS} SELECT query, ps AS positive_score, rank FROM k")
def positive_ranks(t):
    return mining.positive_ranks(_scored(t))


@query(f"""WITH {_SCORED}, w AS (SELECT c.query, page, score, score >= 0.95 * ps AS uncertain FROM c JOIN p ON c.query = p.query WHERE NOT positive)
SELECT query, page, place, uncertain FROM (SELECT *, row_number() OVER (PARTITION BY query, uncertain ORDER BY score DESC, page) AS place FROM w) x WHERE uncertain OR place <= 2""")
def mined_negatives(t):
    return mining.mined_negatives(_scored(t), 2)


@query(f"WITH {_SCORED}, {_RANKS} SELECT count(*) AS questions, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS first, round(avg(CASE WHEN rank <= 4 THEN 1.0 ELSE 0.0 END), 6) AS in_top_4, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr_10 FROM k")
def retrieval_report(t):
    return mining.retrieval_report(mining.positive_ranks(_scored(t)))


@query("SELECT l_returnflag AS model, count(*) AS cases, round(avg(CASE WHEN l_tax > 0.02 THEN 1.0 ELSE 0.0 END), 6) AS passed_rate, round(avg(CASE WHEN l_discount > 0.03 THEN 1.0 ELSE 0.0 END), 6) AS validated_rate, quantile_cont(l_quantity, 0.5) AS median_ms FROM lineitem GROUP BY 1")
def bake_off(t):
    return mining.bake_off(t("lineitem").selectExpr("l_returnflag AS model", "l_orderkey AS case_id", "l_tax > 0.02 AS passed", "l_discount > 0.03 AS validated", "l_quantity AS ms"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')) AS x FROM pages), l AS (SELECT page_id, regexp_extract(x, '(?i)^<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS url, trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM a)
SELECT page_id, url, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(label) DESC, label DESC) AS k FROM l WHERE url <> '') x WHERE k = 1""")
def listing_items(t):
    return listings.listing_items(t("pages"))


@query("""WITH e AS (SELECT l_suppkey % 50 AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'hi' ELSE 'en' END AS language, l_orderkey * 10 + l_linenumber AS place, concat('t', CAST(l_orderkey AS STRING)) AS title, l_returnflag AS listing FROM lineitem WHERE l_linenumber < 3)
SELECT concat('https://x/', CAST(k AS STRING)) AS url, arg_min(title, place) FILTER (language = 'hi') AS hi, arg_min(title, place) FILTER (language = 'en') AS en, array_to_string(list_sort(list_distinct(list(listing))), ',') AS listings,
coalesce(arg_min(title, place) FILTER (language = 'hi'), arg_min(title, place) FILTER (language = 'en')) AS title FROM e GROUP BY k""")
def merged_languages(t):
    links = t("lineitem").where("l_linenumber < 3").selectExpr("CASE WHEN l_linenumber % 2 = 0 THEN 'hi' ELSE 'en' END AS language", "l_orderkey * 10 + l_linenumber AS place", "concat('https://x/', l_suppkey % 50) AS url", "concat('t', l_orderkey) AS title", "l_returnflag AS listing")
    return listings.merge_languages(links).withColumn("listings", F.array_join("listings", ","))


@query("""WITH f AS (SELECT o_orderkey AS place, o_orderkey % 400 AS post_id, unnest([struct_pack(k := 'a', l := CASE WHEN o_orderkey % 3 = 0 THEN 'hi' END, d := NULL, h := 'a.gov', at := 0), struct_pack(k := 'b', l := 'en', d := '2020-01-02', h := CASE WHEN o_orderkey % 4 = 0 THEN 'b.com' ELSE 'a.gov' END, at := 1)]) AS x FROM orders),
g AS (SELECT *, count(*) OVER (PARTITION BY place) > 1 AS several FROM f WHERE x.h = 'a.gov'), s AS (SELECT *, concat('s-', CAST(post_id AS STRING), CASE WHEN several THEN concat('-', coalesce(x.l, x.k)) ELSE '' END) AS source_id FROM g)
SELECT source_id, coalesce(x.d, '2019-05-05') AS go_date FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY place, s.x.at) AS n FROM s) y WHERE n = 1""")
def post_attachments(t):
    k = F.col("o_orderkey")
    file = lambda key, language, date, host: F.struct(F.lit(key).alias("key"), language.alias("language"), date.cast("string").alias("date"), F.concat(F.lit("https://"), host, F.lit(f"/{key}.pdf")).alias("url"))
    files = F.array(file("a", F.when(k % 3 == 0, "hi"), F.lit(None), F.lit("a.gov")), file("b", F.lit("en"), F.lit("2020-01-02"), F.when(k % 4 == 0, "b.com").otherwise("a.gov")))
    posts = t("orders").select(k.alias("place"), F.lit("s").alias("site"), (k % 400).alias("post_id"), F.lit(" title ").alias("title"), F.lit("2019-05-05").alias("date"), files.alias("files"))
    return listings.attachments(posts, ["a.gov"]).select("source_id", "go_date")


@query("""WITH s AS (SELECT c_custkey AS place, CASE c_custkey % 6 WHEN 0 THEN 'Bad Id' WHEN 1 THEN 'same-id' ELSE concat('site-', CAST(c_custkey AS STRING)) END AS id, CASE WHEN c_custkey % 6 = 2 THEN 'village' ELSE 'state' END AS level, c_custkey % 6 AS k FROM customer)
SELECT place, id, CASE k WHEN 0 THEN 'id must be 2-41 lowercase letters, digits and dashes' WHEN 1 THEN 'duplicate id' WHEN 2 THEN 'level must be one of central, state' WHEN 3 THEN 'no listing URLs' WHEN 4 THEN 'bad URL ftp:x' END AS problem
FROM s WHERE k < 5 AND NOT (k = 1 AND place = (SELECT min(place) FROM s WHERE k = 1))""")
def register_problems(t):
    k = F.col("c_custkey") % 6
    ids = F.when(k == 0, "Bad Id").when(k == 1, "same-id").otherwise(F.concat(F.lit("site-"), F.col("c_custkey").cast("string")))
    urls = F.when(k == 3, F.array().cast("array<string>")).when(k == 4, F.array(F.lit("https://a.gov/x"), F.lit("ftp:x"))).otherwise(F.array(F.lit("http://a.gov/x")))
    sites = t("customer").select(F.col("c_custkey").alias("place"), ids.alias("id"), F.when(k == 2, "village").otherwise("state").alias("level"), urls.alias("listing_urls"))
    return listings.register_problems(sites, ["central", "state"], r"\.gov$")


@query("""WITH b AS (SELECT user_id AS listing, event_id AS seq, event_id % 7 AS page, list_sort([CAST(event_id % 3 + user_id * 100 AS STRING), CAST(event_id % 5 + user_id * 100 AS STRING)]) AS ids FROM events),
f AS (SELECT *, first_value(ids) OVER (PARTITION BY listing, page ORDER BY seq) AS f, row_number() OVER (PARTITION BY listing, page ORDER BY seq) AS n FROM b), k AS (SELECT *, CASE WHEN n = 1 THEN 'saved' WHEN ids = f THEN 'repeated' ELSE 'reshuffled' END AS kind FROM f),
s AS (SELECT id, min(seq) AS seq FROM (SELECT seq, unnest(ids) AS id FROM k WHERE kind <> 'repeated') x GROUP BY 1), a AS (SELECT seq, count(*) AS added FROM s GROUP BY 1)
SELECT listing, k.seq, page, kind, coalesce(added, 0) AS added FROM k LEFT JOIN a ON a.seq = k.seq""")
def page_batch_ledger(t):
    ids = F.array_sort(F.array(*[(F.col("event_id") % m + F.col("user_id") * 100).cast("string") for m in (3, 5)]))
    b = t("events").select(F.col("user_id").alias("listing"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("page"), F.lit(2).alias("page_size"), ids.alias("ids"))
    return listings.page_batches(b)


@query("""WITH p AS (SELECT l_orderkey % 100 AS volume, l_orderkey AS chapter_no, l_linenumber AS part_no, min(l_partkey) AS x FROM lineitem GROUP BY 1, 2, 3)
SELECT volume, row_number() OVER (PARTITION BY volume ORDER BY chapter_no, part_no) AS page, concat('[V — C', CASE WHEN count(*) OVER (PARTITION BY volume, chapter_no) > 1 THEN concat(' (part ', CAST(part_no AS STRING), ' of ', CAST(count(*) OVER (PARTITION BY volume, chapter_no) AS STRING), ')') ELSE '' END, ']', chr(10), CAST(x AS STRING)) AS text FROM p""")
def volume_pages(t):
    p = t("lineitem").groupBy((F.col("l_orderkey") % 100).alias("volume"), F.col("l_orderkey").alias("chapter_no"), F.col("l_linenumber").alias("part_no")).agg(F.min("l_partkey").cast("string").alias("text"))
    return listings.volume_parts(p.withColumn("title", F.lit("V")).withColumn("chapter", F.lit("C")))


@query("""SELECT doc_id, array_to_string(list_transform(range(0, CAST(ceil(length(text) / 500) AS BIGINT)), lambda i: CAST(length(substring(text, i * 500 + 1, 500)) AS STRING)), ',') AS sizes FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents WHERE length(text) > 0)""")
def handbook_parts(t):
    """Texts without line ends: parts of 500 characters and the rest."""
    d = t("documents").where(F.length("text") > 0).select("doc_id", F.translate("text", "\n", " ").alias("text"))
    return d.select("doc_id", F.array_join(F.transform(listings.split_text(F.col("text"), 500), lambda x: F.length(x).cast("string")), ",").alias("sizes"))


@query("""WITH o AS (SELECT o_custkey % 100 AS query, o_orderkey AS rank, o_orderstatus AS key, o_orderpriority AS label, o_orderkey % 5 AS pages FROM orders), f AS (SELECT query, key, label, min(rank) AS r FROM o GROUP BY 1, 2, 3), l AS (SELECT query, key, string_agg(label, ' · ' ORDER BY r) AS label FROM f GROUP BY 1, 2),
g AS (SELECT query, key, min(rank) AS best, count(*) AS orders, CAST(sum(pages) AS BIGINT) AS pages FROM o GROUP BY 1, 2) SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY best) AS place, orders, pages, label FROM g JOIN l USING (query, key)""")
def department_sections(t):
    o = t("orders").selectExpr("o_custkey % 100 AS query", "o_orderkey AS rank", "o_orderstatus AS key", "o_orderpriority AS label", "o_orderkey % 5 AS pages")
    return listings.department_sections(o)


@query("SELECT l_orderkey AS query, concat(CAST(count(*) AS STRING), CASE WHEN count(*) = 1 THEN ' page in ' ELSE ' pages in ' END, CAST(count(DISTINCT l_suppkey) AS STRING), CASE WHEN count(DISTINCT l_suppkey) = 1 THEN ' order' ELSE ' orders' END) AS sentence FROM lineitem GROUP BY 1")
def evidence_sentence(t):
    return listings.describe_evidence(t("lineitem").selectExpr("l_orderkey AS query", "l_suppkey AS source_id"))


@query("SELECT coalesce(CASE c_nationkey % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'IN' END, '?') AS code, count(*) AS documents, count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS superseded, count(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 END) AS drafts FROM customer GROUP BY 1")
def jurisdiction_report(t):
    return listings.jurisdiction_report(t("customer").selectExpr("CASE c_nationkey % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'IN' END AS jurisdiction_code", "CASE c_mktsegment WHEN 'BUILDING' THEN 'superseded' WHEN 'FURNITURE' THEN 'draft' END AS status"))


_KIND = "CASE WHEN o_custkey % 10 < 3 THEN 'rulebook' WHEN o_custkey % 10 < 9 THEN 'order' ELSE 'other' END"


@query(f"""WITH p AS (SELECT {_KIND} AS kind, CAST(o_custkey AS STRING) AS source_id, o_orderkey AS page, sha256(concat(CAST(o_custkey AS STRING), '|', CAST(o_orderkey AS STRING))) AS h FROM orders WHERE o_custkey % 50 <> 1),
q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY h) AS n FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h) AS k FROM q WHERE n <= CASE kind WHEN 'rulebook' THEN 8 WHEN 'order' THEN 3 ELSE 4 END)
SELECT kind, source_id, page FROM r WHERE k <= CASE kind WHEN 'rulebook' THEN 70 WHEN 'order' THEN 110 ELSE 20 END""")
def page_sample(t):
    """A sample of two hundred pages: 35, 55 and 10 of a hundred by kind, with a quota for each document."""
    pages = t("orders").selectExpr(f"{_KIND} AS kind", "CAST(o_custkey AS STRING) AS source_id", "o_orderkey AS page")
    return mining.sample_pages(pages, 200, pages.where("CAST(source_id AS INT) % 50 = 1"))


@query("""WITH w AS (SELECT l_orderkey AS query, CAST(l_suppkey % 40 AS STRING) AS source_id, CAST(l_orderkey % 40 AS STRING) AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey) AS rank, l_quantity FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM w WHERE source_id <> pos AND l_quantity <= 25),
d AS (SELECT *, ('0x' || substr(sha256(concat('dev|', pos)), 1, 8))::BIGINT % 100 < 8 AS dev, ('0x' || substr(sha256(concat('dev|', source_id)), 1, 8))::BIGINT % 100 < 8 AS neg FROM g WHERE place <= 3)
SELECT query, string_agg(source_id, ',' ORDER BY place) AS negatives, bool_or(dev) AS dev FROM d GROUP BY 1 HAVING count(*) >= 2 AND (bool_or(dev) OR NOT bool_or(neg))""")
def training_rows(t):
    """Candidates whose words are made of the line's quantity: up to 25 they share two words of four with the right page, else three."""
    words = F.when(F.col("l_quantity") <= 25, F.array(*map(F.lit, "abxy"))).otherwise(F.array(*map(F.lit, "abcx")))
    c = t("lineitem").select(
        F.col("l_orderkey").alias("query"), (F.col("l_suppkey") % 40).cast("string").alias("source_id"), (F.col("l_orderkey") % 40).cast("string").alias("positive_source"),
        F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey)").alias("rank"), words.alias("words"), F.array(*map(F.lit, "abcd")).alias("positive_words"),
    )
    return mining.training_rows(c, 3).withColumn("negatives", F.array_join("negatives", ","))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN concat(CAST(o_orderkey AS STRING), '#', CAST(o_custkey % 9 AS STRING), '#1#2020') END AS source_id, CASE o_orderkey % 4 WHEN 2 THEN 'not the official endpoint' WHEN 3 THEN 'id does not match the link' END AS problem FROM orders""")
def portal_records(t):
    k = F.col("o_orderkey") % 4
    order = F.concat(F.col("o_orderkey").cast("string"), F.lit("#"), (F.col("o_custkey") % 9).cast("string"), F.lit("#1#2020"))
    host = F.when(k == 0, "https://www.Orders.gov/go/view.ASPX").when(k == 1, "http://orders.gov/GO/View.aspx").when(k == 2, "https://other.org/GO/View.aspx").otherwise("https://orders.gov/GO/View.aspx")
    url = F.concat(host, F.lit("?id1="), F.url_encode(F.base64(order.cast("binary"))))
    r = t("orders").select("o_orderkey", records.portal_record(url, F.when(k == 3, "1#1#1#2020").when(k == 0, order), ["orders.gov"], "/GO/View.aspx", "https://orders.gov/GO/View.aspx").alias("r"))
    return r.select("o_orderkey", "r.source_id", "r.problem")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN concat('It is so [S1 p.2].', chr(10), chr(10), 'And more.') WHEN 1 THEN concat('Note: OCR text.', chr(10), chr(10), 'Note: masked numbers.') WHEN 2 THEN concat('It is so [S1 p.2].', chr(10), chr(10), 'Note: see the rules.') ELSE concat('No citation.', chr(10), chr(10), 'Note: verify.') END AS answer FROM lineitem""")
def stripped_notes(t):
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, "It is so [S1 p.2].\n\nAnd more.\n\n**Note:** masked numbers need verification.\n \nनोट: ओसीआर").when(k == 1, "Note: OCR text.\n\nNote: masked numbers.")
    text = text.when(k == 2, "It is so [S1 p.2].\n\nNote: see the rules.").otherwise("No citation.\n\nNote: verify.")
    return t("lineitem").select("l_orderkey", "l_linenumber", checks.without_notes(text).alias("answer"))

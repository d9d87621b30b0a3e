"""Text, curation, search and training-set queries on the operators of this package."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import duplicates as D
from ..operators import ranking as R
from ..operators import state as S
from ..operators import vectors as V
from .registry import query

TIER = "CASE WHEN l.toxic = 1 THEN 'C' WHEN l.quality = 1 THEN 'A' WHEN l.quality = 0 THEN 'B' END"


def _docs(t):
    tier = F.when(F.col("toxic") == 1, "C").when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "B")
    return t("documents").join(t("labels"), "doc_id", "left").withColumn("tier", tier)


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS sha FROM documents""")
def normalize_ws(t):
    return t("documents").select("doc_id", F.sha2(T.normalize_space(F.col("text")), 256).alias("sha"))


@query("SELECT doc_id, d::BIGINT AS devanagari, l::BIGINT AS latin, round(coalesce(d / nullif(d + l, 0), 0), 6) AS hindi_share FROM (SELECT doc_id, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)")
def script_counts(t):
    deva, latin = T.script_counts(F.col("text"))
    counted = t("documents").select("doc_id", deva.cast("long").alias("devanagari"), latin.cast("long").alias("latin"))
    share = F.coalesce(F.col("devanagari") / F.nullif(F.col("devanagari") + F.col("latin"), F.lit(0)), F.lit(0.0))
    return counted.withColumn("hindi_share", F.round(share, 6))


@query()
def text_quality_class(t):
    score = T.text_quality(F.col("text"))
    return t("documents").select("doc_id", score.alias("quality_score"), T.quality_class(score).alias("quality_class"))


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[0-9][0-9.,:/()\-]*'), lambda x: regexp_replace(x, '[.,;:]+$', '')), '|') AS numbers FROM documents""")
def numeric_tokens_all(t):
    found = F.transform(F.regexp_extract_all(T.ascii_digits(F.col("text")), F.lit(r"[0-9][0-9.,:/()\-]*"), F.lit(0)), lambda x: F.regexp_replace(x, r"[.,;:]+$", ""))
    return t("documents").select("doc_id", F.array_join(found, "|").alias("numbers"))


@query(r"""SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9.,:/()\-]*'), lambda x: regexp_replace(x, '[.,;:]+$', ''))))::BIGINT AS n_numbers FROM documents""")
def numeric_tokens(t):
    return t("documents").select("doc_id", F.size(T.numeric_tokens(F.col("text"))).cast("long").alias("n_numbers"))


@query(r"""SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '[0-9]+'))::BIGINT AS n_groups FROM documents""")
def digit_groups(t):
    return t("documents").select("doc_id", F.size(T.digit_groups(F.col("text"))).cast("long").alias("n_groups"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def sha_fingerprint(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("SELECT doc_id, ('0x' || substr(sha256('dev|' || source || '|' || doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 8 AS dev FROM documents")
def dev_split(t):
    return t("documents").select("doc_id", (T.hash_bucket(F.concat_ws("|", F.lit("dev"), "source", F.col("doc_id").cast("string")), 100) < 8).alias("dev"))


@query("SELECT source, sorted[1 + floor((n - 1) * 0.25)::INT] AS p25, sorted[1 + floor((n - 1) * 0.5)::INT] AS p50, sorted[1 + floor((n - 1) * 0.75)::INT] AS p75, sorted[1 + floor((n - 1) * 0.95)::INT] AS p95, sorted[1] AS least, sorted[n] AS most, len(list_filter(sorted, lambda x: x < 120))::BIGINT AS short, len(list_filter(sorted, lambda x: x > 1900))::BIGINT AS long FROM (SELECT source, list(n_chars ORDER BY n_chars) AS sorted, count(*) AS n FROM documents GROUP BY source)")
def chunk_length_percentiles(t):
    """Lower-index percentiles by source. Lengths are counted first, so a source is a histogram and not a list of rows."""
    from pyspark.sql import Window

    hist = t("documents").groupBy("source", "n_chars").agg(F.count("*").alias("k"))
    upto = hist.withColumn("hi", F.sum("k").over(Window.partitionBy("source").orderBy("n_chars"))).join(hist.groupBy("source").agg(F.sum("k").alias("n")), "source")
    at = lambda p: F.min(F.when(F.col("hi") > F.floor((F.col("n") - 1) * p), F.col("n_chars")))
    return upto.groupBy("source").agg(
        at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.95).alias("p95"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"),
        F.coalesce(F.sum(F.when(F.col("n_chars") < 120, F.col("k"))), F.lit(0)).alias("short"), F.coalesce(F.sum(F.when(F.col("n_chars") > 1900, F.col("k"))), F.lit(0)).alias("long"),
    )


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS w FROM documents) GROUP BY w HAVING count(*) >= 2")
def word_frequency(t):
    words = t("documents").select(F.explode(T.tokens(F.lower("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


@query(r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '(^|\.)example\.org$') AS allowed FROM pages")
def url_host_filter(t):
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    return t("pages").select("page_id", host.alias("host"), (host.endswith(".example.org") | (host == "example.org")).alias("allowed"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') AND regexp_matches(text, '[A-Za-z]{3,}') THEN 'mixed' WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(text, '[A-Za-z]{3,}') THEN 'en' ELSE 'unknown' END AS guess FROM documents")
def language_guess(t):
    return t("documents").select("doc_id", T.language(F.col("text")).alias("guess"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"[^\"]*\"'))::BIGINT AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_links(t):
    return t("pages").select("page_id", F.regexp_count("html", F.lit(r'<a [^>]*href="[^"]*"')).cast("long").alias("n_links"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT h.doc_id, h.sha, f.first, f.copies FROM (SELECT doc_id, sha256(text) AS sha FROM documents) h JOIN (SELECT sha256(text) AS sha, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1) f USING (sha) WHERE copies > 1")
def exact_duplicates(t):
    return S.exact_duplicates(t("documents"), "doc_id", "text").select("doc_id", "sha", "first", "copies")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, (quality * 10 + toxic)::BIGINT FROM labels")
def upsert_merge(t):
    return S.upsert(t("documents").select("doc_id", "n_chars"), t("labels").select("doc_id", (F.col("quality") * 10 + F.col("toxic")).cast("long").alias("n_chars")), ["doc_id"])


@query("WITH loaded AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_orderkey % 2 = 0) SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_orderkey NOT IN (SELECT l_orderkey FROM loaded) OR EXISTS (SELECT 1 FROM loaded x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber)")
def scoped_prune(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    loaded = rows.where("l_quantity > 10 and l_orderkey % 2 = 0").select("l_orderkey", "l_linenumber")
    return S.scoped_prune(rows.select("l_orderkey", "l_linenumber"), loaded, "l_orderkey", ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, event_type, entries FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS entries FROM events) WHERE n = 1")
def ledger_latest_state(t):
    return S.latest(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_type", "entries")


@query("SELECT DISTINCT e.l_orderkey AS source_id, e.l_returnflag AS kind, o.o_orderkey AS changed FROM lineitem e JOIN orders o ON (e.l_partkey = o.o_orderkey OR (e.l_suppkey = o.o_custkey AND e.l_shipdate::DATE = o.o_orderdate::DATE)) WHERE e.l_orderkey <> o.o_orderkey")
def later_changes_or_join(t):
    edges = t("lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("target_id"), F.col("l_suppkey").alias("target_key"), F.to_date("l_shipdate").alias("target_day"))
    return S.later_changes(edges, t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day")))


@query("SELECT l_orderkey, l_partkey, l_returnflag FROM (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def strongest_relation(t):
    strength = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return R.first_per(t("lineitem"), ["l_orderkey", "l_partkey"], [strength, "l_linenumber"]).select("l_orderkey", "l_partkey", "l_returnflag")


@query(r"SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'B-low' WHEN regexp_matches(text, '[#*$%&|<>]{3}') THEN 'C' WHEN regexp_matches(text, 'Licen[cs]ed? under') THEN 'A' WHEN regexp_matches(text, '!!') THEN 'C-low' ELSE 'B' END AS class FROM documents")
def classify_rules(t):
    x = F.col("text")
    rules = F.when(F.coalesce(F.trim(x), F.lit("")) == "", "B-low").when(x.rlike(r"[#*$%&|<>]{3}"), "C").when(x.rlike("Licen[cs]ed? under"), "A").when(x.rlike("!!"), "C-low")
    return t("documents").select("doc_id", rules.otherwise("B").alias("class"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'C' END, CASE WHEN d.n_chars < 500 THEN 'B' END, CASE WHEN l.quality = 1 THEN 'A' END, 'B') AS tier, CASE WHEN l.toxic = 1 THEN 'override' WHEN d.n_chars < 500 THEN 'model' ELSE 'rules' END AS decided_by FROM documents d LEFT JOIN labels l USING (doc_id)")
def precedence_merge(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    override, model, rules = F.when(F.col("toxic") == 1, "C"), F.when(F.col("n_chars") < 500, "B"), F.when(F.col("quality") == 1, "A")
    return d.select("doc_id", F.coalesce(override, model, rules, F.lit("B")).alias("tier"), F.when(F.col("toxic") == 1, "override").when(F.col("n_chars") < 500, "model").otherwise("rules").alias("decided_by"))


@query("SELECT d.doc_id, (3 * (len(lower(text)) - len(replace(lower(text), 'the', ''))) / 3 + 2 * (contains(lower(text), 'the'))::INT + 3 * (len(lower(text)) - len(replace(lower(text), 'idiot', ''))) / 5 + 2 * (contains(lower(text), 'idiot'))::INT)::BIGINT AS score FROM documents d WHERE contains(lower(text), 'the') OR contains(lower(text), 'idiot') ORDER BY score DESC, doc_id LIMIT 10")
def term_frequency_search(t):
    """Three points for each occurrence of a term and two for each term found: the ten best."""
    x, score = F.lower("text"), F.lit(0)
    for term in ("the", "idiot"):
        n = F.expr(f"(length(lower(text)) - length(replace(lower(text), '{term}', ''))) div {len(term)}")
        score = score + 3 * n + F.when(x.contains(term), 2).otherwise(0)
    return t("documents").where(x.contains("the") | x.contains("idiot")).select("doc_id", score.cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


_QUERY_VECTOR = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
# Searches ask for every vector whose id is divisible by 20, against all vectors.
_ASKED = "SELECT q.vec_id AS query, r.vec_id, r.label, round(list_cosine_similarity(r.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0"


def _nearest(t, top: int, condition: str = "true"):
    e = t("embeddings")
    return V.nearest(e.where(condition), e.where("vec_id % 20 = 0"), "vec_id", "embedding", top)


def _top(condition: str, top: int) -> str:
    return f"SELECT query, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS k FROM ({_ASKED} AND {condition}) a) b WHERE k <= {top}"


@query(_top("true", 20))
def vector_topk(t):
    return _nearest(t, 20).drop("rank")


@query(_top("r.label IN (1, 2, 3)", 20))
def vector_topk_filtered(t):
    return _nearest(t, 20, "label IN (1, 2, 3)").drop("rank")


@query(f"WITH s AS ({_ASKED}), m AS (SELECT query, greatest(0.45, round(max(similarity) - 0.5, 6)) AS low FROM s GROUP BY 1) SELECT s.query, vec_id, similarity FROM s JOIN m ON m.query = s.query WHERE similarity >= low")
def similarity_floor(t):
    e = t("embeddings")
    return V.above_floor(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 0.45, 0.5)


@query(f"""WITH s AS ({_ASKED}), v AS (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS r FROM s QUALIFY r <= 50),
l AS (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS r FROM s WHERE label IN (1, 2, 3) QUALIFY r <= 50)
SELECT query, vec_id, round(sum(x), 9) AS fused FROM (SELECT query, vec_id, 1.0 / (60 + r) AS x FROM v UNION ALL SELECT query, vec_id, 1.2 / (60 + r) FROM l) GROUP BY 1, 2""")
def rrf_fusion(t):
    """Reciprocal ranks of two searches of each query, one of them among three labels only."""
    weighed = lambda d, w: d.select("query", "vec_id", (F.lit(w) / (60 + F.col("rank"))).alias("x"))
    both = weighed(_nearest(t, 50), 1.0).union(weighed(_nearest(t, 50, "label IN (1, 2, 3)"), 1.2))
    return both.groupBy("query", "vec_id").agg(F.round(F.sum("x"), 9).alias("fused"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n FROM conversations) WHERE n = 1")
def first_hit_per_page(t):
    return R.first_per(t("conversations"), ["conv_id"], [F.desc(F.length("text")), "turn"]).select("conv_id", "turn")


@query("SELECT doc_id, source, n > 2 AS second_pass FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) ORDER BY n > 2, n_chars DESC, doc_id LIMIT 60")
def diversity_cap_topk(t):
    return R.cap_per_source(t("documents"), "source", [F.desc("n_chars"), "doc_id"], 2, 60).select("doc_id", "source", "second_pass")


@query("""WITH p AS (SELECT conv_id AS doc, turn AS page, length(text) AS w FROM conversations), s AS (SELECT doc, page, row_number() OVER (ORDER BY w DESC, doc, page) AS rank FROM p ORDER BY rank LIMIT 20),
c AS (SELECT s.doc, s.page + x.step AS page, s.page AS anchor_page, abs(x.step) AS d, s.rank, x.o FROM s, (VALUES (-1, 0), (1, 1), (-2, 2), (2, 3)) AS x(step, o)),
k AS (SELECT c.* FROM c JOIN p ON c.doc = p.doc AND c.page = p.page WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = c.doc AND s.page = c.page))
SELECT doc, page, anchor_page FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY d, rank, o) AS n FROM k) WHERE n = 1 ORDER BY d, rank, o LIMIT 30""")
def neighbor_expansion(t):
    pages = t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.length("text").alias("w"))
    top = pages.orderBy(F.desc("w"), "doc", "page").limit(20)
    from pyspark.sql import Window

    seeds = top.select("doc", "page", F.row_number().over(Window.orderBy(F.desc("w"), "doc", "page")).alias("rank"))
    return R.neighbours(seeds, pages, 2, 30)


@query(f"""WITH d AS (SELECT d.doc_id, {TIER} AS tier, (1.0 + d.n_chars % 97) / 100 AS p, d.lang = 'en' AS sure, d.n_chars % 7 = 0 AS old FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, round(ln(p / (1 - p)) + CASE WHEN tier = 'A' THEN 1.0 WHEN tier = 'C' THEN CASE WHEN sure THEN -1.5 ELSE -1.0 END ELSE 0 END + CASE WHEN old THEN -2.0 ELSE 0 END, 6) AS score FROM d""")
def authority_rank(t):
    p = (F.lit(1.0) + F.col("n_chars") % 97) / 100
    return _docs(t).select("doc_id", F.round(R.authority_score(p, F.col("tier"), F.col("lang") == "en", F.col("n_chars") % 7 == 0), 6).alias("score"))


@query("""WITH s AS (SELECT user_id, value / 100 AS v FROM events WHERE value IS NOT NULL), b AS (SELECT user_id, bool_and(v BETWEEN 0 AND 1) AS p FROM s GROUP BY user_id)
SELECT user_id, count(*) AS hits, count(*) FILTER (WHERE CASE WHEN p THEN v ELSE 1 / (1 + exp(-v)) END >= 0.6) AS kept FROM s JOIN b USING (user_id) GROUP BY user_id""")
def relevance_gate(t):
    s = t("events").where("value is not null").select("user_id", (F.col("value") / 100).alias("v"))
    b = s.groupBy("user_id").agg(F.bool_and(F.col("v").between(0, 1)).alias("p"))
    return s.join(b, "user_id").groupBy("user_id").agg(F.count("*").alias("hits"), F.count_if(R.relevance(F.col("v"), F.col("p")) >= 0.6).alias("kept"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('s|' || doc_id::VARCHAR), doc_id) AS q FROM documents) WHERE q <= 3")
def stratified_sample(t):
    """A sample: three documents of each source in a language, in hash order."""
    from pyspark.sql import Window

    order = Window.partitionBy("lang", "source").orderBy(F.sha2(F.concat(F.lit("s|"), F.col("doc_id").cast("string")), 256), "doc_id")
    return t("documents").withColumn("q", F.row_number().over(order)).where("q <= 3").select("doc_id", "source")


@query(r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS ws FROM benchmark), e AS (SELECT item_id, unnest(ws) AS w FROM w),
p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM e a JOIN e b ON a.w = b.w AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT p.a, p.b, round(shared::DOUBLE / least(len(x.ws), len(y.ws)), 6) AS overlap FROM p JOIN w x ON p.a = x.item_id JOIN w y ON p.b = y.item_id WHERE shared::DOUBLE / least(len(x.ws), len(y.ws)) >= 0.3""")
def word_overlap_pairs(t):
    w = t("benchmark").select("item_id", F.array_distinct(T.tokens(F.lower("text"))).alias("words"))
    pairs = D.overlap_pairs(w.withColumnRenamed("item_id", "a"), w.withColumnRenamed("item_id", "b"), 0.3).where("a < b")
    return pairs.select("a", "b", F.round("overlap", 6).alias("overlap"))


@query(r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS ws FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS ws FROM documents),
e AS (SELECT item_id, unnest(ws) AS w FROM w), f AS (SELECT doc_id, unnest(ws) AS w FROM d), p AS (SELECT item_id, doc_id, count(*) AS shared FROM e JOIN f USING (w) GROUP BY 1, 2)
SELECT p.item_id, p.doc_id, round(shared::DOUBLE / least(len(w.ws), len(d.ws)), 6) AS overlap FROM p JOIN w USING (item_id) JOIN d USING (doc_id) WHERE shared::DOUBLE / least(len(w.ws), len(d.ws)) >= 0.8""")
def benchmark_overlap(t):
    """Documents that hold eight tenths of the words of an item, or whose own words an item holds."""
    words = F.array_distinct(T.tokens(F.lower("text"))).alias("words")
    items, docs = t("benchmark").select(F.col("item_id").alias("a"), words), t("documents").select(F.col("doc_id").alias("b"), words)
    pairs = D.overlap_pairs(items, docs, 0.8)
    return pairs.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), F.round("overlap", 6).alias("overlap"))

"""The archive's filters, duplicates, relations, hydration and checks as queries over documents made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import unicode as U
from ..operators import checks, duplicates, filters, hits, records, relations
from .registry import query

# Documents of the archive, made of the rows of orders by expressions that both engines read.
DOCS = {
    "n": "o_orderkey",
    "source_id": "CASE WHEN o_orderkey % 11 = 0 THEN concat('core-', CAST(o_orderkey AS STRING)) ELSE concat(CAST(o_orderkey AS STRING), '#', CAST(o_custkey % 25 AS STRING), '#', CAST(o_orderkey % 4 AS STRING), '#', CAST(1990 + o_orderkey % 9 AS STRING)) END",
    "department_id": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 25 END",
    "department": "CASE WHEN o_custkey % 25 > 20 AND o_orderkey % 2 = 0 THEN 'Agriculture Department' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'Irrigation' WHEN 1 THEN concat('कृ‍षि', ' विभाग') WHEN 2 THEN 'Home  and Police' WHEN 3 THEN '' WHEN 4 THEN ' ' END END",
    "jurisdiction_code": "CASE o_orderkey % 7 WHEN 0 THEN 'IN' WHEN 1 THEN 'DL' WHEN 2 THEN NULL ELSE 'UP' END",
    "topic_list": "CASE o_custkey % 4 WHEN 0 THEN 'land,water' WHEN 1 THEN 'police' WHEN 2 THEN 'water,finance' ELSE 'none' END",
    "provenance_ok": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 13 <> 0 END",
    "provider": "CASE WHEN o_orderkey % 11 = 0 THEN 'core-rules' WHEN o_orderkey % 5 = 0 THEN 'district-agra' WHEN o_orderkey % 5 = 1 THEN 'district-bijnor' ELSE 'portal' END",
    "go_number": "concat(CAST(o_orderkey % 60 AS STRING), ' / ', CAST(o_custkey % 9 AS STRING), '-2-', CAST(2015 + o_orderkey % 5 AS STRING))",
    "go_date": "concat(CAST(2015 + o_orderkey % 5 AS STRING), '-0', CAST(1 + o_custkey % 9 AS STRING), '-1', CAST(o_orderkey % 3 AS STRING))",
    "section": "CASE o_orderkey % 5 WHEN 0 THEN 'कृषि अनुभाग-1' WHEN 1 THEN 'कृषि अनुभाग – 12' WHEN 2 THEN 'Budget Section 1' WHEN 3 THEN '' END",
    "category": "CASE o_orderkey % 3 WHEN 0 THEN 'Rules' WHEN 1 THEN concat('Cir‌', 'cular') END",
    "subject": "CASE o_custkey % 5 WHEN 0 THEN 'Solar pump scheme, 50% subsidy' WHEN 1 THEN 'सोलर पम्प योजना' WHEN 2 THEN 'Transfer_of officers' WHEN 3 THEN 'TA bills and DA' ELSE 'Pump sets at 5000 rupees' END",
    "metadata": "CASE WHEN o_orderkey % 19 = 0 THEN '{\"jurisdiction\":\"central\",\"title\":\"\",\"portal\":{\"subject\":\"Portal\"}}' WHEN o_orderkey % 2 = 0 THEN '{\"title\":\"Named\",\"portal\":{\"subject\":\"Portal\"}}' ELSE '{}' END",
    "tier": "CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END",
}
SPELLINGS = {"solar": ["सोलर", "सौर"], "pump": ["पम्प"]}
CTE = "d AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in DOCS.items()) + " FROM orders)"
BARE = "translate({}, '‌‍', '')"


def docs(t):
    d = t("orders").selectExpr(*[f"{e} AS {c}" for c, e in DOCS.items()])
    return d.withColumn("topics", F.split("topic_list", ","))


def _where(condition: str) -> str:
    return f"WITH {CTE} SELECT n FROM d WHERE {condition}"


def _like(pattern: str) -> str:
    search = BARE.format("concat_ws(' ', coalesce(subject, ''), coalesce(section, ''), coalesce(category, ''), coalesce(go_number, ''))")
    return f"{search} ILIKE '{pattern}' ESCAPE '\\'"


def _by_id(match: str, also: str) -> str:
    return _where(f"({match}) OR department_id IN (SELECT department_id FROM d WHERE department_id IS NOT NULL AND {match}) OR {also}")


_AGRI = BARE.format("department") + " ILIKE '%agri%'"
_LIST = BARE.format("department") + " IN ('कृषि विभाग', 'Irrigation')"


@query(_by_id(_AGRI, "provider = 'core-rules'"))
def filter_department_contains(t):
    return filters.department_contains(docs(t), " Agri", ["core-rules"]).select("n")


@query(_by_id(_LIST, "jurisdiction_code = 'IN' OR json_extract_string(metadata, '$.jurisdiction') = 'central' OR provider = 'core-rules'"))
def filter_department_any(t):
    return filters.department_any(docs(t), ["कृ‍षि विभाग", " Irrigation "], ["core-rules"]).select("n")


@query(_by_id(BARE.format("department") + " IN ('कृषि विभाग', 'Agriculture Department')", "json_extract_string(metadata, '$.jurisdiction') = 'central'"))
def filter_department_scope(t):
    return filters.department_scope(docs(t), ["Agriculture Department"], {"Agriculture Department": ["कृषि विभाग"]}).select("n")


@query(_where("department_id IN (3, 7) OR " + BARE.format("department") + " = 'Irrigation' OR trim(coalesce(department, '')) = ''"))
def filter_department_keys(t):
    return docs(t).where(filters.by_department_keys(["id:3", "id:7", "id:x", "name:Irrigation", "none"])).select("n")


@query(_where("department_id IN (1, 2, 24) OR provider = 'core-rules'"))
def filter_department_ids(t):
    return docs(t).where(filters.by_department_ids([1, 2, 24], ["core-rules"])).select("n")


@query(_where("jurisdiction_code IN ('IN', 'DL')"))
def filter_jurisdiction(t):
    return docs(t).where(filters.by_jurisdiction(["in", " dl", "xyz"], two_letters=True)).select("n")


@query(_where("list_has_any(split(topic_list, ','), ['water', 'police'])"))
def filter_topics(t):
    return docs(t).where(filters.by_topic(["water", "police", "No Topic"])).select("n")


@query(_where("provenance_ok"))
def filter_provenance(t):
    return docs(t).where(filters.official_only()).select("n")


@query(_where("go_number ILIKE '%/ 3-2-%'"))
def filter_number_contains(t):
    return docs(t).where(filters.number_contains(" / 3-2-")).select("n")


@query(_where("lower(replace(go_number, ' ', '')) LIKE '5/%'"))
def filter_number_prefix(t):
    return docs(t).where(filters.number_prefix("5 ‍/ ")).select("n")


@query(_where("source_id IN ('core-11', '1#10#1#1991') OR source_id LIKE '2#%'"))
def filter_source_ids(t):
    d = docs(t)
    return d.where(filters.by_source_ids(["core-11", " 1#10#1#1991", ""])).union(d.where(filters.by_source_ids(None) & F.col("source_id").like("2#%"))).union(d.where(filters.by_source_ids([]))).select("n").distinct()


@query(_where("regexp_matches(coalesce(section, ''), '(?i)कृषि\\s+अनुभाग\\s*[-–]?\\s*1([^0-9]|$)') OR regexp_matches(coalesce(section, ''), '(?i)section\\s*[-–]?\\s*1([^0-9]|$)')"))
def filter_section_like(t):
    return docs(t).where(filters.section_like("कृषि अनुभाग 1") | filters.section_like("section – 1")).select("n")


@query(_where("category = 'Rules' OR " + BARE.format("category") + " = 'Circular' AND section = 'Budget Section 1'"))
def filter_named(t):
    return docs(t).where(filters.named("category", "Rules") | filters.named("category", "Circular") & filters.named("section", "Budget  Section 1")).select("n")


@query(_where(f"({_like('%solar p_mp%')} OR {_like('%सोलर p_mp%')} OR {_like('%सौर p_mp%')}) AND {_like('%50\\%%')}"))
def filter_finder_terms(t):
    return docs(t).where(filters.finder_terms(["50%"], ["solar p?mp"], {"solar": SPELLINGS["solar"]})).select("n")


@query(_where(f"({_like('%Solar%')} OR {_like('%सोलर%')} OR {_like('%सौर%')}) AND ({_like('%pump%')} OR {_like('%पम्प%')})"))
def filter_all_words(t):
    return docs(t).where(filters.all_words("Solar  pump", SPELLINGS)).select("n")


@query(_where("provider NOT IN ('district-bijnor')"))
def filter_hidden_providers(t):
    return docs(t).where(filters.hide_providers("Orders for Agra?", {"district-agra": "Agra", "district-bijnor": "Bijnor"})).select("n")


@query(f"WITH {CTE} SELECT n, coalesce(nullif(json_extract_string(metadata, '$.title'), ''), nullif(json_extract_string(metadata, '$.portal.subject'), '')) AS subject FROM d")
def subject_of_metadata(t):
    return docs(t).select("n", filters.subject(F.col("metadata")).alias("subject"))


@query(f"""WITH {CTE}, k AS (SELECT *, trim(regexp_replace({BARE.format("coalesce(department, '')")}, '\\s+', ' ', 'g')) AS name FROM d)
SELECT CASE WHEN regexp_matches(source_id, '^\\d+#\\d+#\\d+#\\d{{4}}$') THEN concat('id:', regexp_extract(source_id, '^\\d+#(\\d+)#', 1)) WHEN name = '' THEN 'none' ELSE concat('name:', name) END AS key,
coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (name <> ''))), '|'), '') AS names, count(*) AS documents FROM k GROUP BY 1""")
def department_facet(t):
    return filters.department_facet(docs(t)).withColumn("names", F.array_join("names", "|"))


# Variants of pages: native, ocr or neither, made of lineitem; a page is an order's supplier.
_PV = "pv AS (SELECT l_orderkey AS source_id, l_suppkey % 6 AS page_number, CASE WHEN l_linenumber % 3 = 0 THEN 'native' WHEN l_linenumber % 3 = 1 THEN 'ocr' ELSE 'html' END AS variant_type, l_orderkey * 10 + l_linenumber AS variant_id, concat('page ', repeat('x', CAST(l_quantity AS INT))) AS text, l_linenumber = 1 AS canonical, l_tax > 0.06 AS conflict FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2) l)"
_PAGES = "pg AS (SELECT source_id, page_number, bool_or(conflict) AS numeric_conflict, bool_or(variant_type = 'native') AS native, bool_or(variant_type = 'ocr') AS ocr FROM pv GROUP BY 1, 2)"


def variants(t):
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_suppkey", "l_quantity", "l_tax")])
    return lines.selectExpr(
        "l_orderkey AS source_id", "l_suppkey % 6 AS page_number", "CASE WHEN l_linenumber % 3 = 0 THEN 'native' WHEN l_linenumber % 3 = 1 THEN 'ocr' ELSE 'html' END AS variant_type",
        "l_orderkey * 10 + l_linenumber AS variant_id", "concat('page ', repeat('x', CAST(l_quantity AS INT))) AS text", "l_linenumber = 1 AS canonical", "l_tax > 0.06 AS conflict",
    )


@query(f"""WITH {_PV}, {_PAGES} SELECT source_id, page_number, CASE WHEN numeric_conflict THEN 'conflict' WHEN native AND ocr THEN 'variants_agree' WHEN native THEN 'native_primary' WHEN ocr THEN 'ocr_only_unverified' ELSE 'unverified' END AS status FROM pg""")
def verification_filter(t):
    """All five filters, one after another, are a partition of the pages."""
    v = variants(t)
    pages = v.groupBy("source_id", "page_number").agg(F.bool_or("conflict").alias("numeric_conflict"))
    out = None
    for s in filters.STATUSES:
        found = filters.by_verification(pages, v, s).select("source_id", "page_number", F.lit(s).alias("status"))
        out = found if out is None else out.union(found)
    return out


@query(f"""WITH {_PV}, q AS (SELECT o_orderkey AS query, unnest([struct_pack(a := 0, s := o_orderkey, p := 3), struct_pack(a := 1, s := o_orderkey + 1, p := 0), struct_pack(a := 2, s := o_orderkey, p := 9), struct_pack(a := 3, s := o_orderkey, p := 1)]) AS x FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_number ORDER BY length(text) DESC, canonical DESC, variant_id) AS k FROM pv)
SELECT query, source_id, page_number, variant_id, concat('S', CAST(row_number() OVER (PARTITION BY query ORDER BY q.x.a) AS STRING)) AS label FROM q JOIN b ON b.source_id = q.x.s AND b.page_number = q.x.p AND k = 1""")
def exact_pages(t):
    ref = lambda s, p: F.struct(s.cast("long").alias("source_id"), F.lit(p).cast("long").alias("page_number"))
    key = F.col("o_orderkey")
    asked = t("orders").select(key.alias("query"), F.array(ref(key, 3), ref(key + 1, 0), ref(key, 9), ref(key, 1)).alias("pages"))
    return hits.exact_pages(asked, variants(t)).select("query", "source_id", "page_number", "variant_id", "label")


# Fused hits: the lines of an order, ranked by price, then by line and supplier; a page is a supplier, a variant a part.
_HITS = "h AS (SELECT l_orderkey AS query, l_suppkey % 4 AS page, l_linenumber % 2 AS variant, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey) AS rank FROM lineitem)"


def fused(t):
    return t("lineitem").selectExpr("l_orderkey AS query", "l_suppkey % 4 AS page", "l_linenumber % 2 AS variant", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey) AS rank")


_POOL = f"{_HITS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, page ORDER BY rank) AS k FROM h) x WHERE k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS pool_rank FROM u), p AS (SELECT query, page, variant, rank, pool_rank, rank > 3 AS backfilled FROM r WHERE rank <= 3 OR pool_rank <= 3)"


@query(f"WITH {_POOL} SELECT * FROM p")
def rerank_pool(t):
    return hits.rerank_pool(fused(t), count=3, top_k=4).select("query", "page", "variant", "rank", "pool_rank", "backfilled")


@query(f"""WITH {_POOL}, o AS (SELECT h.*, row_number() OVER (PARTITION BY h.query, h.page ORDER BY h.rank) AS k FROM h JOIN p ON h.query = p.query AND h.page = p.page AND h.variant <> p.variant)
SELECT query, page, variant, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS a FROM o WHERE k = 1) x WHERE a <= 2""")
def alternate_variants(t):
    h = fused(t)
    return hits.alternates(h, hits.rerank_pool(h, 3, 4), budget=2).select("query", "page", "variant", "rank")


@query(f"""WITH {_PV}, {_PAGES}, c AS (SELECT source_id, page_number, arg_min(text, variant_id) AS text FROM pv WHERE canonical GROUP BY 1, 2),
h AS (SELECT pv.*, pg.numeric_conflict FROM pv JOIN pg USING (source_id, page_number) WHERE variant_id % 3 = 0),
e AS (SELECT h.variant_id, h.text AS selected_text, coalesce(c.text, h.text) AS canonical_text, h.numeric_conflict, h.source_id, h.page_number FROM h LEFT JOIN c USING (source_id, page_number))
SELECT e.variant_id, selected_text, canonical_text, CASE WHEN numeric_conflict THEN coalesce((SELECT array_to_string(list(o.text ORDER BY o.variant_id), '|') FROM pv o WHERE o.source_id = e.source_id AND o.page_number = e.page_number AND o.variant_id <> e.variant_id AND o.text <> e.selected_text AND o.text <> e.canonical_text), '') ELSE '' END AS other_texts,
CASE WHEN source_id % 3 = 0 AND page_number = 2 THEN 'https://x/b' ELSE concat('https://d/', CAST(source_id AS STRING), '#page=', CAST(page_number AS STRING)) END AS page_url, source_id % 3 = 1 AND page_number IN (1, 4) OR source_id % 3 = 2 AS legacy_font FROM e""")
def hydrated_hits(t):
    v = variants(t)
    pages = v.groupBy("source_id", "page_number").agg(F.bool_or("conflict").alias("numeric_conflict"))
    h = v.where("variant_id % 3 = 0").select("source_id", "page_number", "variant_id", "variant_type").join(pages, ["source_id", "page_number"]).withColumn("query", F.lit(1))
    d = t("orders").selectExpr("o_orderkey AS source_id", "concat('https://d/', o_orderkey) AS source_url", """CASE o_orderkey % 3 WHEN 0 THEN '{"pageUrls":["","https://x/b"]}' WHEN 1 THEN '{"html":{"legacyFontPages":[1,4]}}' ELSE '{"pageCorpus":{"krutiDevPages":2}}' END AS metadata""")
    return hits.hydrate(h, v, d).select("variant_id", "selected_text", "canonical_text", F.array_join("other_texts", "|").alias("other_texts"), "page_url", "legacy_font")


@query("""WITH e AS (SELECT l_orderkey AS query, l_suppkey % 5 AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey) AS rank, l_discount * 10 AS relevance, CASE WHEN l_linenumber = 7 THEN 'neighbor' END AS role,
 CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('long title ', 20) ELSE concat('Title  ', CAST(l_suppkey % 5 AS STRING)) END AS title, CASE WHEN l_suppkey % 2 = 0 THEN '12/2020' ELSE '' END AS go_number, CASE WHEN l_suppkey % 3 = 0 THEN '2020-01-01' END AS go_date FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY query, source_id ORDER BY rank) AS k FROM e WHERE relevance >= 0.25 AND role IS NULL), s AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM b WHERE k = 1 AND title <> '')
SELECT query, place, source_id, CASE WHEN length(t) > 140 THEN concat(substring(t, 1, 137), '…') ELSE t END AS title, nullif(concat_ws(', ', nullif(go_number, ''), go_date), '') AS reference FROM s WHERE place <= 3""")
def closest_documents(t):
    e = t("lineitem").selectExpr(
        "l_orderkey AS query", "l_suppkey % 5 AS source_id", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey) AS rank", "l_discount * 10 AS relevance",
        "CASE WHEN l_linenumber = 7 THEN 'neighbor' END AS role", "CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('long title ', 20) ELSE concat('Title  ', l_suppkey % 5) END AS title",
        "CASE WHEN l_suppkey % 2 = 0 THEN '12/2020' ELSE '' END AS go_number", "CASE WHEN l_suppkey % 3 = 0 THEN '2020-01-01' END AS go_date",
    )
    return hits.closest_documents(e, least=0.25)


@query("""SELECT doc_id FROM documents WHERE NOT (coalesce(CASE WHEN doc_id % 7 <> 0 THEN 'm1' END, '') = 'm1' AND coalesce(CASE WHEN doc_id % 5 = 0 THEN 512 ELSE 1024 END, 0) = 1024 AND coalesce(CASE WHEN doc_id % 3 = 0 THEN sha256(text) WHEN doc_id % 3 = 1 THEN sha256(concat(text, 'x')) END, '') = sha256(text))""")
def stale_embeddings(t):
    d = t("documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 7 != 0, "m1").alias("embedding_model"), F.when(F.col("doc_id") % 5 == 0, 512).otherwise(1024).alias("embedding_dim"),
        F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).alias("embedding_hash"),
    )
    return hits.stale_embeddings(d, "m1", 1024).select("doc_id")


@query("""WITH p AS (SELECT doc_id % 97 AS source_id, CASE WHEN (doc_id % 97) % 4 = 0 THEN 'ocr' WHEN (doc_id % 97) % 4 = 1 AND doc_id % 5 = 0 THEN 'ocr' ELSE 'native' END AS s, text, doc_id % 6 = 0 AS legacy FROM documents)
SELECT source_id, count(*) AS pages, CASE WHEN min(s) = max(s) THEN min(s) ELSE 'mixed' END AS text_source, count(CASE WHEN legacy THEN 1 END) AS legacy_pages, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes FROM p GROUP BY 1""")
def corpus_audit(t):
    p = t("documents").selectExpr("doc_id % 97 AS source_id", "doc_id AS page_number", "CASE WHEN (doc_id % 97) % 4 = 0 THEN 'ocr' WHEN (doc_id % 97) % 4 = 1 AND doc_id % 5 = 0 THEN 'ocr' ELSE 'native' END AS text_source", "text", "doc_id % 6 = 0 AS legacy_font")
    return hits.corpus_audit(p)


# Captures: half of the documents are the archive, the others new captures of a few orders each.
def _capture(d):
    return d.select(
        F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("text_hash"), F.when(F.col("doc_id") % 9 == 0, F.sha2(F.substring("text", 1, 40), 256)).alias("file_hash"),
        F.concat(F.floor(F.col("doc_id") / 20).cast("string"), F.lit("/x-2020")).alias("go_number"), F.concat(F.lit("2020-01-1"), (F.col("doc_id") % 3).cast("string")).alias("go_date"), "text",
    )


@query(r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(substring(text, 1, 4000)), '[\p{L}\p{M}\p{N}]+'), lambda x: length(x) >= 3)) AS w, sha256(text) AS th, CASE WHEN doc_id % 9 = 0 THEN sha256(substring(text, 1, 40)) END AS fh,
 concat(CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING), '|', CAST(doc_id % 3 AS STRING)) AS k FROM documents), a AS (SELECT * FROM w WHERE doc_id % 2 = 1), b AS (SELECT * FROM w WHERE doc_id % 2 = 0),
f AS (SELECT a.doc_id, max(b.doc_id) AS of FROM a JOIN b ON a.fh = b.fh GROUP BY 1), t AS (SELECT a.doc_id, max(b.doc_id) AS of FROM a JOIN b ON a.th = b.th GROUP BY 1),
e AS (SELECT doc_id, 'exact' AS kind, of FROM f UNION ALL SELECT doc_id, 'exact', of FROM t WHERE doc_id NOT IN (SELECT doc_id FROM f)),
m AS (SELECT a.doc_id, b.doc_id AS of, CASE WHEN len(a.w) >= 15 AND len(b.w) >= 15 THEN len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) ELSE 0 END AS score, len(a.w) >= 15 AND len(b.w) >= 15 AS compared FROM a JOIN b USING (k) WHERE a.doc_id NOT IN (SELECT doc_id FROM e)),
g AS (SELECT doc_id, max(score) AS score, bool_or(compared) AS compared, min(of) AS lo FROM m GROUP BY 1)
SELECT doc_id AS source_id, kind, of FROM e UNION ALL SELECT g.doc_id, CASE WHEN score >= 0.5 THEN 'same-order' ELSE 'possible' END, CASE WHEN score >= 0.5 THEN (SELECT min(m.of) FROM m WHERE m.doc_id = g.doc_id AND m.score = g.score) ELSE lo END FROM g WHERE score >= 0.5 OR NOT compared""")
def duplicate_captures(t):
    d = t("documents")
    return duplicates.find_duplicates(_capture(d.where("doc_id % 2 = 1")), _capture(d.where("doc_id % 2 = 0"))).select("source_id", "kind", "of")


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN concat('c', CAST(event_id AS STRING)) END, concat('legacy-', substring(sha256(props), 1, 16))) AS capture_id, row_number() OVER w AS version,
lag(coalesce(CASE WHEN event_id % 3 <> 0 THEN concat('c', CAST(event_id AS STRING)) END, concat('legacy-', substring(sha256(props), 1, 16)))) OVER w AS previous_capture_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, coalesce(CASE WHEN event_id % 3 <> 0 THEN concat('c', CAST(event_id AS STRING)) END, concat('legacy-', substring(sha256(props), 1, 16))))""")
def capture_history(t):
    e = t("events").select(F.col("user_id").alias("source_id"), "event_id", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("capture_id"), F.col("ts").alias("captured_at"), F.sha2("props", 256).alias("file_hash"))
    return duplicates.capture_history(e).select("event_id", "capture_id", "version", "previous_capture_id")


# References: each line refers to the number and date of the order that its part names.
_REL = f"""{CTE}, k AS (SELECT n, concat(CAST(n % 60 AS STRING), '/', CAST(2015 + n % 5 AS STRING)) AS target_key, go_date AS target_date FROM d),
r AS (SELECT l_orderkey AS source_id, l_linenumber - 1 AS place, CASE WHEN l_linenumber = 1 THEN 'subject' ELSE concat('page ', CAST(l_linenumber - 1 AS STRING)) END AS found_in, k.target_key, k.target_date, CASE l_returnflag WHEN 'R' THEN 'amends' WHEN 'A' THEN 'supersedes' ELSE 'refers' END AS kind FROM lineitem JOIN k ON k.n = l_partkey),
b AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_key, target_date ORDER BY kind = 'refers', place, kind) AS q FROM r),
f AS (SELECT source_id, target_key, target_date, kind, found_in, (SELECT CASE WHEN count(*) = 1 THEN min(k.n) END FROM k WHERE k.target_key = b.target_key AND k.target_date = b.target_date AND k.n <> b.source_id) AS target_source_id FROM b WHERE q = 1),
c AS (SELECT o_orderkey AS source_id, k.target_key, k.target_date, 'amends' AS kind, 'catalogue' AS found_in, k.n AS target_source_id FROM orders JOIN k ON k.n = o_custkey WHERE o_orderkey % 10 = 0),
z AS (SELECT * FROM c UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source_id = f.source_id AND c.target_key = f.target_key AND c.target_date = f.target_date))"""


def _relations(t):
    orders = docs(t).select(F.col("n").alias("source_id"), "go_number", "go_date")
    known = docs(t).selectExpr("n AS l_partkey", "concat(CAST(n % 60 AS STRING), '/', CAST(2015 + n % 5 AS STRING)) AS target_key", "go_date AS target_date")
    refs = t("lineitem").join(known, "l_partkey").selectExpr(
        "l_orderkey AS source_id", "l_linenumber - 1 AS place", "CASE WHEN l_linenumber = 1 THEN 'subject' ELSE concat('page ', CAST(l_linenumber - 1 AS STRING)) END AS found_in", "target_key", "target_date",
        "CASE l_returnflag WHEN 'R' THEN 'amends' WHEN 'A' THEN 'supersedes' ELSE 'refers' END AS kind", "'evidence' AS evidence",
    )
    catalogue = t("orders").where("o_orderkey % 10 = 0").selectExpr("o_orderkey AS source_id", "o_custkey AS target_id", "'amends' AS kind")
    return relations.build_relations(refs, catalogue, orders), orders


@query(f"WITH {_REL} SELECT source_id, target_key, target_date, kind, found_in, coalesce(target_source_id, -1) AS target_source_id FROM z")
def built_relations(t):
    return _relations(t)[0].select("source_id", "target_key", "target_date", "kind", "found_in", F.coalesce("target_source_id", F.lit(-1)).alias("target_source_id"))


@query(f"WITH {_REL} SELECT kind, count(*) AS relations, count(target_source_id) AS resolved FROM z GROUP BY 1")
def relation_counts(t):
    return relations.relation_counts(_relations(t)[0])


@query(f"WITH {_REL} SELECT n AS source_id, n IN (SELECT target_source_id FROM z WHERE kind = 'supersedes' AND target_source_id IS NOT NULL) AS superseded FROM d")
def superseded_orders(t):
    found, orders = _relations(t)
    return relations.mark_superseded(orders, found).select("source_id", "superseded")


@query("""SELECT o_orderkey, o_orderkey % 4 IN (1, 3) AS has, o_orderkey % 4 = 1 AS listed FROM orders""")
def json_containment(t):
    m = F.concat(F.lit('{"a":['), F.when(F.col("o_orderkey") % 4 == 1, "1,7").when(F.col("o_orderkey") % 4 == 3, "7").otherwise("2"), F.lit("]}"))
    return t("orders").select("o_orderkey", records.json_has(m, "$.a", F.lit(7)).alias("has"), (F.size(records.json_texts(m, "$.a")) == 2).alias("listed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('{"a":"', CAST(o_custkey AS STRING), '","b":"new","c":"1"}') ELSE '{"b":"new","c":"1"}' END AS merged FROM orders""")
def json_merge(t):
    a = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"a":"'), F.col("o_custkey").cast("string"), F.lit('","b":"old"}')))
    return t("orders").select("o_orderkey", records.json_merge(a, F.lit('{"b":"new","c":"1"}')).alias("merged"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'case-specific' WHEN o_orderkey % 4 = 2 THEN 'rules' END AS label, CASE WHEN o_orderkey % 4 = 3 THEN -1 ELSE o_custkey END AS value FROM orders""")
def model_reply_labels(t):
    kind = F.when(F.col("o_orderkey") % 4 == 0, "Case Specific").when(F.col("o_orderkey") % 4 == 1, "individual").when(F.col("o_orderkey") % 4 == 2, " RULES ").otherwise("poem")
    reply = F.concat(F.lit('<think>{"type": "no"}</think> Sure: {"type": "'), kind, F.lit('", "value": '), F.col("o_custkey").cast("string"), F.lit("}"))
    reply = F.when(F.col("o_orderkey") % 4 == 3, F.lit("I cannot say.")).otherwise(reply)
    r = t("orders").select("o_orderkey", records.model_reply(reply, "type string, value long").alias("r"))
    return r.select("o_orderkey", records.clamp(F.col("r.type"), ["case-specific", "rules"], {"individual": "case-specific"}).alias("label"), F.coalesce("r.value", F.lit(-1)).alias("value"))


@query("""WITH u AS (SELECT unnest(list(o_orderkey ORDER BY o_orderkey)) AS k, unnest(list(o_orderpriority ORDER BY o_orderkey)) AS p FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(u.p, o_orderstatus) ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN u ON u.k = o_orderkey""")
def attribute_merge(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    parts = o.where("o_orderkey % 3 = 0").groupBy((F.col("o_orderkey") % 64).alias("g")).agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("x"))
    updates = records.unnest(parts.selectExpr("x.o_orderkey AS o_orderkey", "x.o_orderpriority AS o_orderstatus"), "o_orderkey", "o_orderstatus")
    return records.merge_attributes(o.drop("o_orderpriority"), updates, "o_orderkey", ["o_orderstatus"])


@query("""WITH k AS (SELECT o_orderkey AS n, o_custkey % 3 AS s FROM orders WHERE o_orderkey % 5 <> 0), g AS (SELECT DISTINCT n + d AS n, s FROM k, (SELECT unnest(generate_series(-2, 2)) AS d) x)
SELECT concat(CAST(n AS STRING), '#1#', CAST(s AS STRING), '#2020') AS source_id FROM g WHERE n > 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.n = g.n AND k.s = g.s)""")
def probe_grid(t):
    known = t("orders").where("o_orderkey % 5 <> 0").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("#1#"), (F.col("o_custkey") % 3).cast("string"), F.lit("#2020")).alias("source_id"))
    return records.probe_grid(known, 2)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 11 = 0 THEN concat('core-', CAST(o_orderkey AS STRING), '/raw.pdf') ELSE concat(CAST(o_orderkey AS STRING), '-', CAST(o_custkey % 25 AS STRING), '-', CAST(o_orderkey % 4 AS STRING), '-', CAST(1990 + o_orderkey % 9 AS STRING), '/raw.pdf') END AS object_key,
o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS verified, CASE o_orderkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'pdf' WHEN 2 THEN 'empty-html' ELSE 'html' END AS probe FROM orders""")
def stored_copies(t):
    d = t("orders").selectExpr("o_orderkey", f"{DOCS['source_id']} AS source_id", "CASE WHEN o_orderkey % 4 = 1 THEN '../x' ELSE 'raw.pdf' END AS name")
    k = F.col("o_orderkey")
    return d.select(
        "o_orderkey", records.object_key(F.col("source_id"), F.col("name")).alias("object_key"),
        records.verified_copy(F.when(k % 3 == 0, "b").otherwise("c"), "b", F.lit("AB"), F.lit("ab"), F.when(k % 2 == 0, "f1"), F.lit("f2")).alias("verified"),
        records.probe_class(F.when(k % 5 == 0, 404).otherwise(200), F.when(k % 5 == 1, "application/pdf; x").otherwise("text/html"), F.when(k % 5 == 2, 10).otherwise(5000)).alias("probe"),
    )


@query("""SELECT s_suppkey, CASE WHEN n.n_nationkey IS NOT NULL THEN n.n_nationkey END AS code FROM supplier LEFT JOIN nation n ON n.n_nationkey = s_nationkey""")
def place_codes(t):
    n = t("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("The "), F.col("n_name"), F.lit("."))).alias("aliases"))
    asked = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("the "), F.lower("n_name")).alias("name"))
    return records.place_codes(asked, n).select("s_suppkey", "code")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' ORDER BY turn DESC, conv_id LIMIT 500")
def recent_first(t):
    return records.recent_first(t("conversations").where("role = 'user'").select("conv_id", "turn", "text"), "turn", 9999)


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'a' WHEN o_custkey % 4 = 1 THEN 'hi' ELSE 'en' END AS x FROM orders WHERE false UNION ALL
SELECT l_orderkey * 10 + l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 'hi' WHEN l_linenumber % 4 = 3 THEN 'hi' ELSE 'en' END FROM lineitem""")
def response_language(t):
    q = F.when(F.col("l_linenumber") % 4 == 0, "नियम क्या है").when(F.col("l_linenumber") % 4 == 1, "What is the नियम").when(F.col("l_linenumber") % 4 == 2, "42?").otherwise("GO का नियम")
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o_orderkey"), P.response_language(q).alias("x"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(trim(substring(text, 1, CASE WHEN length(regexp_extract(substring(text, 1, 201), '(?s)^(.*) [^ ]*$', 1)) > 120 THEN length(regexp_extract(substring(text, 1, 201), '(?s)^(.*) [^ ]*$', 1)) ELSE 200 END)), ' …') END AS snippet FROM documents")
def snippets(t):
    return t("documents").select("doc_id", P.shorten(F.col("text"), 200).alias("snippet"))


@query(r"SELECT doc_id, length(text) >= 400 AND len(regexp_extract_all(text, '[\p{L}\p{M}]')) >= 0.45 * length(text) AS usable FROM documents")
def usable_pages(t):
    return t("documents").select("doc_id", filters.usable_page(F.col("text")).alias("usable"))


@query("SELECT doc_id, lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS k FROM documents")
def unicode_keys(t):
    return t("documents").select("doc_id", U.department_key(F.col("text")).alias("k"))


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;|&#160;', ' ', 'g'), '&amp;', '&'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '\s+', ' ', 'g')) AS x FROM pages")
def page_plain_text(t):
    return t("pages").select("page_id", P.plain_text(F.col("html")).alias("x"))


_TURN = "CASE turn % 5 WHEN 0 THEN 'Was this order amended later?' WHEN 1 THEN 'क्या इस आदेश में संशोधन हुआ' WHEN 2 THEN 'What is the rate of interest' WHEN 3 THEN 'Is the above GO still valid' ELSE text END"


@query(f"SELECT conv_id, turn, turn % 5 IN (0, 1, 3) AS later, turn % 5 IN (0, 1, 3) AS earlier FROM (SELECT conv_id, turn, {_TURN} AS q FROM conversations WHERE turn % 5 < 4)")
def followup_cues(t):
    q = F.expr(_TURN)
    return t("conversations").where("turn % 5 < 4").select("conv_id", "turn", checks.asks_about_changes(q).alias("later"), checks.refers_to_earlier_document(q).alias("earlier"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'What is rule 21?' WHEN 1 THEN 'नियम 21 क्या है' END AS accepted, l_linenumber % 4 = 0 AS no_answer FROM lineitem""")
def corrections_and_refusals(t):
    k = F.col("l_linenumber") % 4
    old = F.when(k == 0, "wht is rule 21?").when(k == 1, "नियम 21 kya है").otherwise("what is rule 21?")
    new = F.when(k == 0, "What is  rule 21?").when(k == 1, "नियम 21 क्या है").when(k == 2, "what is rule 22?").otherwise("What is rule 21?")
    draft = F.when(k == 0, "NO_ANSWER_IN_EVIDENCE The provided documents do not contain it.").when(k == 1, "The order sets the rate. The provided pages do not say when.").otherwise("It is 21 [S1].")
    return t("lineitem").select("l_orderkey", "l_linenumber", checks.accepted_correction(old, new).alias("accepted"), checks.no_answer(draft).alias("no_answer"))


@query("""WITH i AS (SELECT l_orderkey AS query, l_linenumber AS pos, CASE l_linenumber % 5 WHEN 0 THEN '"What is the rate?",' WHEN 1 THEN 'what is  the rate' WHEN 2 THEN 'see https://x.y' WHEN 3 THEN 'नियम क्या कहता है' ELSE concat('Which part is number ', CAST(min(l_partkey) AS STRING)) END AS item FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT query, pos, CASE l WHEN 0 THEN 'What is the rate?' WHEN 1 THEN 'what is the rate?' ELSE concat(item, '?') END AS item, CASE WHEN l < 2 THEN 'whatistherate' ELSE lower(item) END AS k FROM (SELECT *, pos % 5 AS l FROM i) x WHERE l NOT IN (2, 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY query, k ORDER BY pos) AS n FROM c) SELECT query, row_number() OVER (PARTITION BY query ORDER BY pos) AS place, item FROM o WHERE n = 1 QUALIFY place <= 3""")
def suggestions(t):
    k = F.col("l_linenumber") % 5
    item = F.when(k == 0, '"What is the rate?",').when(k == 1, "what is  the rate").when(k == 2, "see https://x.y").when(k == 3, "नियम क्या कहता है").otherwise(F.concat(F.lit("Which part is number "), F.col("l_partkey").cast("string")))
    rows = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(F.col("l_orderkey").alias("query"), F.lit("Is it so?").alias("question"), F.lit("en").alias("language"), F.col("l_linenumber").alias("at"), item.alias("item"))
    return checks.clean_suggestions(rows)


@query("""SELECT o_orderkey AS case_id, o_orderkey % 6 = 0 OR o_orderkey % 6 = 1 AS passed, CASE o_orderkey % 6 WHEN 2 THEN 'expected source' WHEN 3 THEN 'five words|final punctuation' WHEN 4 THEN 'found' WHEN 5 THEN 'answered|validated|five words|final punctuation|required words' ELSE '' END AS failed FROM orders""")
def case_checks(t):
    k = F.col("o_orderkey") % 6
    none = F.array().cast("array<string>")
    cases = t("orders").select(
        F.col("o_orderkey").alias("case_id"), F.when(k == 2, F.array(F.lit("a"))).otherwise(none).alias("expected_sources"), none.alias("expected_pages"), (k == 1).alias("not_found"),
        F.when(k == 5, F.array(F.lit("rate"))).otherwise(none).alias("required"), F.array(F.lit("as an")).alias("forbidden_prefixes"),
    )
    text = F.when(k == 1, "The provided documents do not contain it. There is no information on the rate.").when(k == 3, "Four words it is").when(k == 4, "The provided pages do not say it. The available orders only cover X.")
    text = F.when(k == 5, F.lit(None)).otherwise(F.coalesce(text, F.lit("The rate is five percent [S1].")))
    answers = t("orders").select(F.col("o_orderkey").alias("case_id"), text.alias("answer"), F.lit(True).alias("validated"), F.array(F.lit("b")).alias("sources"), none.alias("pages")).where(k != 5)
    return checks.case_checks(cases, answers).select("case_id", "passed", F.array_join("failed", "|").alias("failed"))

"""Browse, facets, joins, windows and state over the tables, as SQL that both engines run."""

from .registry import sql

DOCS = (
    "docs AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, CASE WHEN l.toxic = 1 THEN 'C' WHEN l.quality = 1 THEN 'A' WHEN l.quality = 0 THEN 'B' END AS tier "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)

# a page of the listing: the limit is the page
sql("browse_page", f"WITH {DOCS} SELECT doc_id, source, tier, n_chars FROM docs WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 5000 ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50")
sql("browse_total", f"WITH {DOCS} SELECT count(*) AS total FROM docs WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 5000")
sql("provider_exclusion", f"WITH {DOCS} SELECT doc_id, source FROM docs WHERE NOT (source IN ('src0', 'src1'))")
sql("facet_source", "SELECT CASE WHEN source IS NULL THEN 'none' ELSE concat('name:', source) END AS facet, count(*) AS documents, count(DISTINCT lang) AS languages FROM documents GROUP BY 1")
sql("facet_section", "SELECT lang AS section, count(*) AS documents FROM documents WHERE lang IS NOT NULL GROUP BY lang")
sql("tier_facet", f"WITH {DOCS} SELECT coalesce(tier, 'none') AS tier, count(*) AS documents FROM docs GROUP BY 1")
sql("tier_filter_none", f"WITH {DOCS} SELECT doc_id FROM docs WHERE tier IS NULL OR tier = 'A'")
sql("facet_nation_left_join", "SELECT n.n_name, count(c.c_custkey) AS holders FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY n.n_name")
sql("null_safe_gate", f"WITH {DOCS} SELECT doc_id, tier FROM docs WHERE tier IS DISTINCT FROM 'C' OR coalesce(lang, 'low') <> 'en'")
sql("routine_skip", f"WITH {DOCS}, skip AS (SELECT doc_id FROM docs WHERE tier = 'C') SELECT d.doc_id FROM documents d LEFT ANTI JOIN skip s ON d.doc_id = s.doc_id",
    f"WITH {DOCS}, skip AS (SELECT doc_id FROM docs WHERE tier = 'C') SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM skip s WHERE s.doc_id = d.doc_id)")
sql("status_filter_exists", """WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, CASE WHEN f.r AND f.a THEN 'conflict' WHEN f.r THEN 'ocr_only' WHEN f.a THEN 'native_primary' WHEN f.n THEN 'agree' ELSE 'unverified' END AS status
FROM orders o LEFT JOIN f ON f.l_orderkey = o.o_orderkey""")
sql("indexed_flag", "SELECT o.o_orderkey, l.l_orderkey IS NOT NULL AS indexed FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) l ON l.l_orderkey = o.o_orderkey")
sql("dept_widened_match", """WITH ids AS (SELECT DISTINCT c_nationkey FROM customer WHERE lower(c_name) LIKE '%00077%'),
m AS (SELECT c.c_custkey, lower(c.c_name) LIKE '%00077%' AS named, i.c_nationkey IS NOT NULL AS widened FROM customer c LEFT JOIN ids i ON c.c_nationkey = i.c_nationkey)
SELECT c_custkey, named FROM m WHERE named OR widened""")
sql("evidence_joins", "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_nationkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_quantity > 45")
sql("lateral_top1", """SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, l_linenumber, l_quantity,
row_number() OVER (PARTITION BY l_orderkey ORDER BY (CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) DESC, l_quantity DESC, l_linenumber) AS n FROM lineitem) x WHERE n = 1""")
sql("latest_prior_user_turn", """SELECT conv_id, turn, asked FROM (SELECT conv_id, turn, role,
max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations) x WHERE role = 'assistant'""")
sql("message_feedback_left_join", """WITH f AS (SELECT user_id, max(event_id) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.event_id, e.user_id, f.last_error FROM events e LEFT JOIN f ON e.user_id = f.user_id WHERE e.event_type = 'purchase'""")
sql("department_choice_window", """WITH names AS (SELECT s_nationkey AS k, s_name AS name, count(*) AS documents FROM supplier GROUP BY s_nationkey, s_name)
SELECT k, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY documents DESC, name) AS n FROM names) x WHERE n = 1""")
sql("union_distinct_choices", "SELECT c_nationkey AS choice FROM customer UNION SELECT s_nationkey FROM supplier")
sql("bool_or_inventory", """SELECT o.o_orderkey, bool_or(l.l_returnflag = 'R') AS native, bool_or(l.l_returnflag = 'A') AS ocr,
coalesce(max(CASE WHEN l.l_linenumber = 1 THEN l.l_shipdate END), max(l.l_shipdate)) AS shown FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
sql("corpus_audit_counts", """SELECT count(*) AS documents, count(CASE WHEN text IS NULL OR text = '' THEN 1 END) AS empty_texts, count(CASE WHEN n_chars < 120 THEN 1 END) AS short_texts,
count(CASE WHEN n_chars > 1900 THEN 1 END) AS long_texts, count(CASE WHEN n_chars <> length(text) THEN 1 END) AS wrong_lengths, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages FROM documents""")
sql("anti_join_done", "SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
sql("auto_archive", """WITH u AS (SELECT user_id, max(ts) AS updated, max(CASE WHEN event_type = 'signup' THEN ts END) AS restored, bool_or(event_type = 'purchase' AND value > 190) AS pinned FROM events GROUP BY user_id),
t AS (SELECT max(ts) AS now FROM events) SELECT u.user_id, u.pinned, (NOT u.pinned AND greatest(u.updated, coalesce(u.restored, u.updated)) < t.now - INTERVAL 3 DAY) AS archived FROM u, t""")
sql("scd2_active", """SELECT user_id, event_type, valid_from FROM (SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events) x WHERE valid_to IS NULL""")
sql("ledger_reconciliation", """SELECT event_type AS listing, count(*) AS entries, count(DISTINCT user_id) AS ids, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY event_type""")
sql("feedback_totals", "SELECT event_type AS rating, count(*) AS answers FROM events GROUP BY event_type")
sql("profile_counts", """WITH e AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT c.c_custkey, coalesce(e.n, 0) AS messages FROM customer c LEFT JOIN e ON e.user_id = c.c_custkey""")
sql("session_resolve", "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20 00:00:00' AND value IS NOT NULL")
sql("known_id_audit", """SELECT o_orderpriority AS department, count(*) AS ids, min(o_orderkey) AS lowest, max(o_orderkey) AS highest, count(DISTINCT o_orderstatus) AS labels, count(*) - count(DISTINCT o_orderkey) AS repeated FROM orders GROUP BY o_orderpriority""")
sql("classification_summary", f"WITH {DOCS} SELECT coalesce(tier, 'none') AS tier, lang, count(*) AS n FROM docs GROUP BY 1, 2")
sql("storage_projection", f"""WITH {DOCS}, t AS (SELECT coalesce(tier, 'none') AS tier, avg(CAST(n_chars AS DOUBLE)) AS mean, count(*) AS n FROM docs GROUP BY 1)
SELECT round(sum(mean * n / (SELECT count(*) FROM documents) * 1000000), 2) AS projected FROM t""")
sql("per_day_first_ten", """SELECT day, o_orderkey FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, o_orderkey, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders) x WHERE n <= 10""")
sql("hit_at_k", """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
h AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN rank END) AS hit FROM r GROUP BY user_id)
SELECT user_id, coalesce(hit <= 1, false) AS at_1, coalesce(hit <= 4, false) AS at_4, coalesce(round(1.0E0 / hit, 6), 0.0E0) AS reciprocal FROM h""")
sql("eval_summary", """SELECT event_type, count(*) AS cases, round(avg(CASE WHEN value > 50 THEN 1.0E0 ELSE 0.0E0 END), 6) AS rate, round(median(value), 6) AS middle FROM events GROUP BY event_type""")
sql("threshold_calibration", """WITH m AS (SELECT event_type, min(CASE WHEN user_id % 2 = 0 THEN value END) AS lo, max(CASE WHEN user_id % 2 = 1 THEN value END) AS hi FROM events GROUP BY event_type)
SELECT event_type, CASE WHEN lo > hi THEN round((lo + hi) / 2, 6) END AS threshold FROM m""")
sql("amended_orders_running", """SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM orders""")
sql("daily_credit_budget", """SELECT event_id, used FROM (SELECT event_id, event_type, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM events) x WHERE used <= 5""")
# of lines with the same price the first is the best page
_BEST_PAGE = """SELECT l_orderkey, min_by(l_linenumber, CASE WHEN l_extendedprice IS NOT NULL THEN {pair} END) AS best_page, max(l_extendedprice) AS score, count(*) AS pages FROM (SELECT l_orderkey, l_linenumber, -l_extendedprice AS l_extendedprice FROM lineitem) x GROUP BY l_orderkey"""
sql("group_pages_by_order", _BEST_PAGE.format(pair="struct(l_extendedprice, l_linenumber)"), _BEST_PAGE.format(pair="row(l_extendedprice, l_linenumber)"))
sql("strong_weak_split", """SELECT o_orderkey, o_totalprice >= 0.25 * max(o_totalprice) OVER (PARTITION BY o_custkey) AS strong FROM orders""")

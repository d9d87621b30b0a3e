"""Overlays, ledgers, gates, evaluation and training-set queries, as SQL that both engines run."""

from .registry import sql

sql("json_path", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
sql("searchable_text", "SELECT p_partkey, concat(coalesce(p_name, ''), ' ', coalesce(p_brand, ''), ' ', coalesce(p_type, '')) AS searchable FROM part")
sql("wildcard_like", r"SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%re_ %g%' OR p_name LIKE '%100\\%%'", r"SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%re_ %g%' OR p_name LIKE '%100\%%' ESCAPE '\'")
sql("words_and_spellings", """SELECT doc_id FROM documents WHERE (lower(text) LIKE '%the%' OR lower(text) LIKE '%der%') AND (lower(text) LIKE '%licen%' OR lower(text) LIKE '%ing%')""")
sql("date_range_page", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
sql("key_facet", "SELECT CASE WHEN c_mktsegment IS NULL THEN 'none' WHEN c_custkey % 2 = 0 THEN concat('id:', CAST(c_nationkey AS STRING)) ELSE concat('name:', c_mktsegment) END AS facet, count(*) AS documents, min(c_mktsegment) AS shown, count(DISTINCT c_mktsegment) AS spellings FROM customer GROUP BY 1")
sql("single_candidate", """WITH c AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS target FROM orders GROUP BY 1, 2 HAVING count(*) = 1)
SELECT l.l_orderkey, l.l_linenumber, coalesce(c.target, -1) AS target FROM lineitem l LEFT JOIN c ON l.l_suppkey = c.k AND CAST(l.l_shipdate AS DATE) = c.d AND c.target <> l.l_orderkey""")
sql("overlay_merge", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars % 2) AS quality, coalesce(CAST(l.toxic AS BIGINT), 0) AS toxic, d.doc_id IS NOT NULL AS listed, l.doc_id IS NOT NULL AS captured
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
sql("status_counts", """SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY o_orderpriority""")
sql("status_samples", "SELECT o_orderstatus, o_orderkey, n FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) x WHERE n <= 12")
sql("text_encoding_class", """WITH c AS (SELECT doc_id, octet_length(text) AS bytes, length(text) AS chars, regexp_count(text, '[ऀ-ॿ]') AS hindi, regexp_count(text, '[ÃÂâ€�]') AS broken, regexp_count(text, '\\\\p{L}') AS letters FROM documents)
SELECT doc_id, CASE WHEN bytes < 100 THEN 'needs-ocr' WHEN chars < 250 THEN 'sparse' WHEN broken > 0.01 * letters THEN 'suspicious' WHEN hindi >= 0.15 * letters THEN 'hindi' ELSE 'english' END AS class FROM c""",
    r"""WITH c AS (SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS hindi, len(regexp_extract_all(text, '[ÃÂâ€�]')) AS broken, len(regexp_extract_all(text, '\p{L}')) AS letters FROM documents)
SELECT doc_id, CASE WHEN bytes < 100 THEN 'needs-ocr' WHEN chars < 250 THEN 'sparse' WHEN broken > 0.01 * letters THEN 'suspicious' WHEN hindi >= 0.15 * letters THEN 'hindi' ELSE 'english' END AS class FROM c""")
sql("ocr_recommendation", """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax * 1000 - l_discount * 1000 >= 15 AND l_quantity >= least(20.0E0, l_extendedprice / 2) THEN 'prefer-ocr' WHEN l_tax * 1000 - l_discount * 1000 <= -15 THEN 'prefer-native' ELSE 'manual' END AS choice FROM lineitem""")
sql("portal_reconciliation", """WITH g AS (SELECT event_type AS listing, count(DISTINCT user_id) AS pages, count(*) AS row_count, count(CASE WHEN value IS NULL THEN 1 END) AS retry, max(event_id) AS last_total FROM events GROUP BY event_type)
SELECT listing, pages, row_count, retry, row_count - retry AS waiting, greatest(CAST(ceil(last_total / 10.0E0) AS BIGINT) - pages, 0) AS missing_pages FROM g""")
sql("newest_per_kind", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) x WHERE n <= 8")
sql("later_change_fold", """WITH r AS (SELECT l_partkey, l_orderkey, max(CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE 2 END) AS strength, max(l_shipdate) AS day FROM lineitem GROUP BY l_partkey, l_orderkey)
SELECT l_partkey, l_orderkey, strength FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC, l_orderkey) AS n FROM r) x WHERE n <= 3""")
sql("candidate_queue", """SELECT p_partkey, tier FROM (SELECT p_partkey, p_size, CASE p_type WHEN 'ECONOMY' THEN 'A' WHEN 'SMALL' THEN 'B' ELSE 'C' END AS tier FROM part WHERE p_size <= 30) x
ORDER BY CASE tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END, p_size, p_partkey LIMIT 100""")
sql("empty_days", """WITH span AS (SELECT explode(sequence(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY)) AS day)
SELECT CAST(s.day AS STRING) AS day FROM span s LEFT ANTI JOIN (SELECT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND o_totalprice > 250000) o ON o.day = s.day""",
    "WITH span AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(day AS STRING) AS day FROM span WHERE day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 250000)")
sql("expansion_merge", """WITH a AS (SELECT l_partkey AS id, sum(l_discount) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey), b AS (SELECT l_partkey AS id, sum(l_tax) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey)
SELECT id, round(sum(s), 6) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY id""")
sql("evidence_merge", """WITH n AS (SELECT l_orderkey, l_partkey, 0 AS part, l_linenumber AS r FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, l_partkey, 1, l_linenumber FROM lineitem),
f AS (SELECT l_orderkey, l_partkey, part, r FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY part, r) AS k FROM n) x WHERE k = 1)
SELECT l_orderkey, l_partkey, concat('S', CAST(place AS STRING)) AS label FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY part, r, l_partkey) AS place FROM f) y WHERE place <= 5""")
sql("soft_delete_purge", """WITH u AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN ts END) AS deleted_at, max(CASE WHEN event_type = 'signup' THEN ts END) AS restored_at FROM events GROUP BY user_id), t AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN deleted_at IS NULL OR restored_at > deleted_at THEN 'active' WHEN deleted_at + INTERVAL 7 DAY <= now THEN 'purge' ELSE 'deleted' END AS state FROM u, t""")
sql("scd2_close_and_insert", """WITH asked AS (SELECT c_custkey AS k, (c_nationkey + 1) % 25 AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT c.c_custkey AS k, c.c_nationkey AS v, a.k IS NULL OR a.v = c.c_nationkey AS active FROM customer c LEFT JOIN asked a ON c.c_custkey = a.k
UNION ALL SELECT a.k, a.v, true FROM asked a JOIN customer c ON a.k = c.c_custkey WHERE a.v <> c.c_nationkey""")
sql("taxonomy_case", """SELECT s.s_suppkey, CASE WHEN s.s_nationkey % 7 = 0 THEN upper(substring(n.n_name, 1, 2)) WHEN s.s_acctbal > 5000 THEN 'IN' ELSE 'UP' END AS jurisdiction, CASE WHEN s.s_acctbal < 0 THEN 'superseded' ELSE 'current' END AS status FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""")
sql("provenance_host", r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages) SELECT page_id, CASE WHEN host = '' THEN 'unknown' WHEN host LIKE '%.org' OR host LIKE '%.edu' THEN 'official' ELSE 'other' END AS provenance FROM h""")
sql("orders_with_strong_pages", """WITH g AS (SELECT l_orderkey, max(l_discount) AS best, count(*) AS pages FROM lineitem GROUP BY l_orderkey), t AS (SELECT *, max(best) OVER (PARTITION BY pages) AS top FROM g)
SELECT l_orderkey, pages, best >= greatest(0.05E0, 0.25E0 * top) AS strong FROM t""")
sql("evidence_badge", """SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) WHEN bool_or(l_returnflag IN ('R', 'A')) THEN 'mixed' ELSE 'native' END AS badge FROM lineitem GROUP BY l_orderkey""")
sql("editions", """SELECT doc_id, e.edition, CASE WHEN e.edition = 'short' THEN substring(text, 1, 80) ELSE text END = text AS whole FROM (SELECT doc_id, text, explode(CASE WHEN length(text) > 80 THEN array('short', 'full') ELSE array('full') END) AS edition FROM documents) e""",
    """SELECT doc_id, edition, CASE WHEN edition = 'short' THEN substring(text, 1, 80) ELSE text END = text AS whole FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) > 80 THEN ['short', 'full'] ELSE ['full'] END) AS edition FROM documents) e""")
sql("catalogue_violations", r"""SELECT 'no https' AS rule, count(*) AS n FROM pages WHERE NOT (url LIKE 'https://%') UNION ALL SELECT 'url twice', count(*) FROM (SELECT url FROM pages GROUP BY url HAVING count(*) > 1) d
UNION ALL SELECT 'label without document', count(*) FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL UNION ALL SELECT 'order without customer', count(*) FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL""")
sql("hash_refresh", """WITH a AS (SELECT source, sum(n_chars) AS h FROM documents GROUP BY source), b AS (SELECT source, sum(n_chars) AS h FROM documents WHERE lang <> 'de' GROUP BY source)
SELECT a.source, CASE WHEN b.source IS NULL THEN 'new' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM a LEFT JOIN b ON a.source = b.source""")
sql("promoted_labels", """SELECT l_suppkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS label, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey""")
sql("misspelt_names", """SELECT p_partkey, p_name FROM part WHERE levenshtein(p_type, 'ECONOMI') <= 2""", """SELECT p_partkey, p_name FROM part WHERE levenshtein(p_type, 'ECONOMI') <= 2""")
sql("hard_negatives", """WITH q AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
slots AS (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)
SELECT p.l_orderkey, s.i AS slot, g.l_partkey AS negative FROM q p JOIN slots s ON true JOIN q g ON g.l_orderkey = p.l_orderkey AND g.r = 2 + s.i % (p.n - 1) WHERE p.r = 1 AND p.n > 1""")
sql("filter_case_checks", """WITH got AS (SELECT o_custkey, count(*) AS found, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS wrong FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey)
SELECT c.c_custkey, coalesce(g.found, 0) > 0 AS expected_found, coalesce(g.wrong, 0) = 0 AS all_satisfy FROM customer c LEFT JOIN got g ON g.o_custkey = c.c_custkey""")
sql("numeric_conflict_pages", r"""WITH w AS (SELECT conv_id, role, n FROM (SELECT conv_id, role, explode(regexp_extract_all(text, '[0-9]+', 0)) AS n FROM conversations) x), p AS (SELECT conv_id, n, bool_or(role = 'user') AS a, bool_or(role = 'assistant') AS b FROM w GROUP BY conv_id, n)
SELECT conv_id, count(CASE WHEN a AND NOT b THEN 1 END) AS only_user, count(CASE WHEN b AND NOT a THEN 1 END) AS only_assistant FROM p GROUP BY conv_id""",
    r"""WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(text, '[0-9]+')) AS n FROM conversations), p AS (SELECT conv_id, n, bool_or(role = 'user') AS a, bool_or(role = 'assistant') AS b FROM w GROUP BY conv_id, n)
SELECT conv_id, count(CASE WHEN a AND NOT b THEN 1 END) AS only_user, count(CASE WHEN b AND NOT a THEN 1 END) AS only_assistant FROM p GROUP BY conv_id""")
sql("weighted_lexicon", r"""SELECT w AS word, sum(p) AS weight FROM (SELECT explode(regexp_extract_all(lower(text), '[\\p{L}\\p{M}]{3,}', 0)) AS w, 3 AS p FROM benchmark UNION ALL SELECT explode(regexp_extract_all(lower(text), '[\\p{L}\\p{M}]{3,}', 0)), 1 FROM documents) x GROUP BY w HAVING sum(p) >= 2""",
    r"""SELECT w AS word, CAST(sum(p) AS BIGINT) AS weight FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]{3,}')) AS w, 3 AS p FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]{3,}')), 1 FROM documents) x GROUP BY w HAVING sum(p) >= 2""")
sql("previous_version", "SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn), -1) AS previous, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS version FROM conversations")
sql("prior_user_turns", "SELECT conv_id, turn, count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked_before FROM conversations")
sql("last_message_title", "SELECT conv_id, max(turn) AS turns, min(CASE WHEN role = 'user' THEN turn END) AS first_question FROM conversations GROUP BY conv_id")

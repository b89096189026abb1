"""DuckDB SQL for each of ``queries.QUERIES``."""

from . import analytic_sql, ordered_sql, scoring_sql, search_sql, stream_sql, table_sql

_VERDICTS = "SELECT doc_id, (quality = 1 AND toxic <> 1) AS relevant, (toxic = 1) AS hallucination, (quality + toxic = 0) AS refusal FROM labels"
_RESULTS = f"""SELECT d.doc_id, d.lang, d.source, v.relevant, v.hallucination, v.refusal, d.n_chars::DOUBLE AS latency_ms,
  CASE WHEN v.relevant THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS citation_score, d.n_chars / 1e6::DOUBLE AS judge_cost_usd
FROM documents d LEFT JOIN ({_VERDICTS}) v USING (doc_id)"""
_RATE = "avg(CASE WHEN relevant IS NOT NULL THEN coalesce({0}, false)::INT::DOUBLE END)"
_UPPER = "(percentile_disc(0.5) WITHIN GROUP (ORDER BY {0} DESC))::DOUBLE"

ORACLE = {
    "judged_metrics_by_lang": f"""
SELECT lang, count(*) AS n, avg(relevant::INT::DOUBLE) AS relevance_rate, avg(hallucination::INT::DOUBLE) AS hallucination_rate,
  avg(n_chars::DOUBLE) AS len_avg, {_UPPER.format('n_chars')} AS len_p50
FROM documents JOIN ({_VERDICTS}) USING (doc_id) GROUP BY lang""",
    "run_summary": f"""
SELECT count(*) AS total, coalesce({_RATE.format('relevant')}, 0) AS relevance_rate, coalesce({_RATE.format('hallucination')}, 0) AS hallucination_rate,
  coalesce({_RATE.format('refusal')}, 0) AS refusal_rate, coalesce(avg(citation_score), 0) AS citation_accuracy, coalesce(avg(latency_ms), 0) AS latency_ms_avg,
  coalesce({_UPPER.format('latency_ms')}, 0) AS latency_ms_p50, sum(judge_cost_usd) AS judge_cost_usd FROM ({_RESULTS})""",
    "metrics_by_source": f"""
SELECT source, count(*) AS count, coalesce({_RATE.format('relevant')}, 0) AS relevance_rate, coalesce({_RATE.format('hallucination')}, 0) AS hallucination_rate,
  coalesce({_RATE.format('refusal')}, 0) AS refusal_rate, avg(citation_score) AS citation_accuracy, avg(latency_ms) AS latency_ms_avg FROM ({_RESULTS}) GROUP BY source""",
    "upper_median_by_type": f"SELECT event_type, {_UPPER.format('value')} AS p50 FROM events GROUP BY event_type",
    "true_median_by_type": "SELECT event_type, median(value) AS p50, avg(nullif(value, 0)) AS mean_nonzero FROM events GROUP BY event_type",
    "left_outer_unjudged": f"SELECT doc_id, lang, coalesce(relevant::VARCHAR, '(missing)') AS relevant FROM documents LEFT JOIN ({_VERDICTS}) USING (doc_id)",
    "resume_pending": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "coverage_flag": "SELECT o_orderkey AS k, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM orders",
    "set_difference": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "set_intersection": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "outcome_class": f"""
SELECT doc_id, outcome, CASE WHEN outcome = 'relevant' THEN 'ok' WHEN outcome IN ('hallucination', 'wrong') THEN 'fail' ELSE '' END AS card,
  CASE WHEN citation_score >= 1 THEN 'yes' ELSE 'no' END AS cell
FROM (SELECT *, CASE WHEN relevant IS NULL THEN 'missing' WHEN refusal THEN 'refusal' WHEN hallucination THEN 'hallucination' WHEN relevant THEN 'relevant' ELSE 'wrong' END AS outcome FROM ({_RESULTS}))""",
    "rate_classes": f"""
SELECT source, CASE WHEN a IS NULL THEN NULL WHEN a >= 0.5 THEN 'good' ELSE 'bad' END AS relevance_class,
  CASE WHEN b IS NULL THEN NULL WHEN b >= 0.3 THEN 'bad' ELSE 'good' END AS hallucination_class
FROM (SELECT source, avg(relevant::INT) AS a, avg(hallucination::INT) AS b FROM ({_RESULTS}) GROUP BY source)""",
    "crosstab_zero_filled": """
SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es,
  count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'it') AS it FROM documents GROUP BY source""",
    "keyword_frequency": """
WITH k(needle, label) AS (VALUES ('example.com', 'com'), ('example.net', 'net'), ('/en/', 'english'), ('utm_source', 'campaign'))
SELECT label, count(*) AS n, min(page_id) AS first_page FROM pages JOIN k ON contains(url, needle) GROUP BY label""",
    "groups_satisfied": """
WITH g AS (SELECT l_orderkey, l_linenumber, bool_or(p_size < 25) AS hit FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_orderkey, count(*) FILTER (coalesce(hit, false))::DOUBLE / count(*) AS score, count(*) AS groups FROM g GROUP BY l_orderkey""",
    "legacy_scores": """
WITH h AS (SELECT conv_id, count(*) AS groups, count(*) FILTER (turn % 2 <> 0 OR turn = 2) AS hits FROM conversations GROUP BY conv_id)
SELECT conv_id, hits::DOUBLE / groups AS legacy_score, CASE WHEN hits = groups THEN 'fully' WHEN hits > 0 THEN 'partially' ELSE 'not_at_all' END AS legacy_establishes, groups FROM h""",
    "script_ratio": """
SELECT lang, avg(a::DOUBLE / (a + b + 1)) AS ratio
FROM (SELECT lang, length(regexp_replace(text, '[^à-ÿÀ-ß]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS b FROM documents) GROUP BY lang""",
    "has_number": r"SELECT lang, count(*) FILTER (regexp_matches(text, '\p{Nd}')) AS with_number, count(*) AS n FROM documents GROUP BY lang",
    "truncate_text": "SELECT doc_id, length(text[1:6000]) AS n, md5(text[1:6000]) AS md5 FROM documents",
    "host_class": """
SELECT CASE WHEN contains(url, 'spam-farm.example') THEN 'spam' WHEN contains(url, 'example.com') THEN 'com' WHEN contains(url, 'example') THEN 'other example' ELSE 'other' END AS host,
  count(*) AS n FROM pages GROUP BY 1""",
    "json_field": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
    "json_truthiness": "SELECT event_id, event_id % 7 IN (0, 1, 3) AS relevant FROM events",
    "ordered_messages": r"""
SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS md5, count(*) AS turns FROM conversations GROUP BY conv_id""",
    "last_wins": "SELECT user_id, arg_max_null(event_type, event_id) AS event_type, arg_max_null(value, event_id) AS value FROM events GROUP BY user_id",
    "dedupe_positions": "SELECT user_id, min(event_id) AS pos, arg_max_null(event_type, event_id) AS event_type, arg_max_null(value, event_id) AS value FROM events GROUP BY user_id",
    "first_n": "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 25",
    "token_cost": """
SELECT conv_id, (sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::DOUBLE * 0.5::DOUBLE + sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::DOUBLE * 2.0::DOUBLE) / 1e6::DOUBLE AS cost_usd
FROM conversations GROUP BY conv_id""",
    "replicate_agreement": """
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS q, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE toxic END AS t FROM labels)
SELECT count(*) AS n, count(*) FILTER (q = quality) AS same_relevant, count(*) FILTER (t = toxic) AS same_hallucination FROM labels JOIN b USING (doc_id)""",
    "histogram_25": "SELECT least(floor(o_totalprice / 20000.0::DOUBLE), 24)::INT AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1",
    "box_stats": """
SELECT lang, count(n_chars) AS n, min(n_chars)::DOUBLE AS lowest, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.5) AS median,
  quantile_cont(n_chars::DOUBLE, 0.75) AS q3, max(n_chars)::DOUBLE AS highest, avg(n_chars::DOUBLE) AS mean FROM documents GROUP BY lang""",
    "sort_nulls": "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id",
    "global_and_grouped": f"""
SELECT lang, source, count(*) AS n, avg(relevant::INT::DOUBLE) AS relevance_rate, avg(latency_ms) AS latency_avg,
  CASE grouping(lang, source) WHEN 3 THEN '' WHEN 1 THEN 'lang' ELSE 'source' END AS grouping FROM ({_RESULTS}) GROUP BY GROUPING SETS ((), (lang), (source))""",
    "rate_by_category": f"""
SELECT source, coalesce(avg(relevant::INT::DOUBLE) FILTER (lang = 'de'), 0) AS easy, coalesce(avg(relevant::INT::DOUBLE) FILTER (lang = 'en'), 0) AS medium,
  coalesce(avg(relevant::INT::DOUBLE) FILTER (lang = 'es'), 0) AS hard FROM ({_RESULTS}) GROUP BY source""",
    "path_normalise": r"""
SELECT page_id, path, split_part(path, '/', 1) AS first, split_part(path, '/', -1) AS name, lower(regexp_extract(split_part(path, '/', -1), '(?s)^\.*[^.].*?(\.[^.]+)$', 1)) AS suffix
FROM (SELECT page_id, replace(regexp_replace(url, '^https?://', '') || '.aspx.txt', '.aspx.txt', '.txt') AS path FROM pages)""",
    "all_any_quantifiers": """
SELECT l_orderkey, bool_and(hit) AS all_any FROM (SELECT l_orderkey, l_linenumber, bool_or(l_quantity > 10) AS hit FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""",
    "first_pages_concat": r"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS pages FROM conversations),
s AS (SELECT conv_id, pages, (string_agg('[page ' || r || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY r) || CASE WHEN pages > 5 THEN chr(10) || chr(10) || '[truncated: ' || pages || ' pages total]' ELSE '' END)[1:6000] AS x
  FROM t WHERE r <= 5 GROUP BY conv_id, pages)
SELECT conv_id, md5(x) AS md5, length(x) AS n, pages FROM s""",
    "multi_run_union_compare": """
WITH b AS (SELECT * FROM labels JOIN documents USING (doc_id)),
u AS (SELECT 'a' AS run_label, quality AS f, false AS refusal, doc_id, n_chars, text FROM b UNION ALL SELECT 'b', toxic, NULL, doc_id, n_chars, text FROM b)
SELECT run_label, count(*) AS count, avg(f::DOUBLE) AS citation_accuracy, avg(n_chars::DOUBLE) FILTER (doc_id % 7 <> 0 AND n_chars <> 0) AS latency_avg,
  median(n_chars::DOUBLE) FILTER (doc_id % 7 <> 0 AND n_chars <> 0) AS latency_p50, avg(length(text)::DOUBLE) AS answer_len_avg, avg((f = 1)::INT::DOUBLE) AS relevance_rate,
  avg((f = 0)::INT::DOUBLE) AS hallucination_rate, avg(coalesce(refusal, false)::INT::DOUBLE) AS refusal_rate FROM u GROUP BY run_label""",
    "explorer_filter_sort": f"""
SELECT doc_id::VARCHAR AS id, CASE lang WHEN 'de' THEN 'easy' WHEN 'en' THEN 'medium' WHEN 'es' THEN 'hard' ELSE 'unknown' END AS difficulty, 'relevant' AS outcome
FROM documents JOIN ({_VERDICTS}) USING (doc_id) WHERE (contains(lower(text), 'than') OR contains(doc_id::VARCHAR, 'than')) AND relevant AND NOT hallucination AND NOT refusal
ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE -1 END DESC, doc_id""",
    "payload_runs": f"""
SELECT d.doc_id::VARCHAR AS id, 2::BIGINT AS n,
  CASE WHEN relevant IS NULL THEN 'missing' WHEN refusal THEN 'refusal' WHEN hallucination THEN 'hallucination' WHEN relevant THEN 'relevant' ELSE 'wrong' END AS first,
  CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'a' ELSE '(missing)' END AS second
FROM documents d LEFT JOIN ({_VERDICTS}) v USING (doc_id)""",
    "text_profile": f"""
SELECT count(*) AS count, {_UPPER.format('length(text)')} AS length_p50,
  avg(length(regexp_replace(text, '[^֐-׿]', '', 'g'))::DOUBLE / (length(regexp_replace(text, '[^֐-׿]', '', 'g')) + length(regexp_replace(text, '[^A-Za-z]', '', 'g')) + 1)) AS hebrew_ratio_avg FROM documents""",
    "corpus_totals": """
SELECT (SELECT count(*) FROM documents) AS files, (SELECT sum(n_chars)::BIGINT FROM documents) AS bytes, (SELECT count(DISTINCT source) FROM documents) AS domains,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) AS docs_max, (SELECT count(*) FROM labels) AS questions, (SELECT count(*) FILTER (quality = 1) FROM labels) AS with_number""",
    "kinds_by_domain": r"""
SELECT domain, count(*) FILTER (contains(url, '.html')) AS pdf, 0::BIGINT AS txt, CASE domain WHEN 'com' THEN 'Commercial' WHEN 'net' THEN 'Network' ELSE domain END AS label
FROM (SELECT url, regexp_extract(url, 'example\.(\w+)/', 1) AS domain FROM pages) GROUP BY domain""",
    "domain_gaps": "SELECT s_nationkey::VARCHAR AS domain, count(*) AS docs, s_nationkey IN (SELECT c_nationkey FROM customer) AS has_questions FROM supplier GROUP BY s_nationkey",
    "axis_headroom": """
SELECT event_type, CASE WHEN max(value) <= 100 THEN least(100, max(value) * 1.28::DOUBLE + 10) ELSE max(value) * 1.18::DOUBLE + greatest(max(value) * 0.05::DOUBLE, 50) END AS top,
  CASE WHEN max(value) * 1000 <= 100 THEN least(100, max(value) * 1000 * 1.28::DOUBLE + 10) ELSE max(value) * 1000 * 1.18::DOUBLE + greatest(max(value) * 1000 * 0.05::DOUBLE, 50) END AS far,
  15.0::DOUBLE AS none FROM events GROUP BY event_type""",
    "escaped": """
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS md5 FROM pages""",
} | scoring_sql.ORACLE | stream_sql.ORACLE | ordered_sql.ORACLE | table_sql.ORACLE | search_sql.ORACLE | analytic_sql.ORACLE

"""DuckDB SQL for each of ``table_queries.QUERIES``."""

from .scoring_sql import _ANSWERS, _PAGES, _RESOLVED, _ROWS

ORACLE = {
    "run_specs": """
WITH s AS (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN url IS NOT NULL THEN 'Few Shot ' || page_id END WHEN 1 THEN 'no-cite-' || page_id || '.eval' ELSE 'a' END AS label,
    CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'runs/no-cite-' || page_id || '.eval.json' ELSE page_id || '|c' END AS path FROM pages)
SELECT *, 'prov/m' || page_id AS model, 'http://h' || page_id || '/ask' AS endpoint,
  CASE WHEN label LIKE 'Few%' THEN 'default' WHEN label LIKE 'no-cite%' THEN 'no-cite' ELSE 'baseline' END AS preset,
  CASE WHEN label LIKE 'Few%' THEN 'default.md' WHEN label LIKE 'no-cite%' THEN 'no-cite.md' END AS prompt,
  CASE WHEN label LIKE 'Few%' THEN 'e.json' END AS examples_file, CASE WHEN label LIKE 'Few%' THEN 22 ELSE 2 END::BIGINT AS message_count FROM s""",
    "files_of_kind": "SELECT page_id, url, 'txt' AS kind FROM pages WHERE page_id % 3 = 1",
    "explorer_by_domain": """
WITH d AS (SELECT doc_id::VARCHAR AS id, source AS domain, text FROM documents WHERE doc_id % 3 = 1)
SELECT 0 AS n, id, domain, 'medium' AS difficulty FROM d WHERE domain = 'src1' AND (contains(lower(text), 'en') OR contains(id, 'en'))
UNION ALL SELECT 1, id, domain, 'medium' FROM d WHERE contains(text, '1') OR contains(id, '1')""",
    "report_parts": f"{_ROWS} SELECT id, domain, difficulty, answer, latency_ms, citation_score, citation_establishes, relevant, hallucination, refusal, judge_reasoning, judge_cost_usd FROM o",
    "ordered_log": "SELECT 'u' || user_id AS id, arg_max(event_type || ' é ' || event_id, event_id) AS answer, arg_max(value, event_id) AS latency_ms FROM events GROUP BY user_id",
    "citation_requests": f"""WITH {_PAGES},{_ANSWERS},{_RESOLVED},
b AS (SELECT id, string_agg('--- Citation ' || (cite_pos + 1) || ': ' || file || CASE WHEN coalesce(page, 0) <> 0 THEN ' (page ' || page || ')' ELSE '' END || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY cite_pos) AS x
  FROM r GROUP BY id HAVING bool_and(ok))
SELECT id, md5('Question: Q ' || id || chr(10) || 'Answer: ' || coalesce(nullif(answer, ''), '(empty answer)') || chr(10) || chr(10) || x) AS md5 FROM a JOIN b USING (id)""",
    "citation_replies": """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'not_at_all' ELSE ['fully', 'partially', 'not_at_all', 'not_at_all'][(event_id % 4)::INT + 1] END AS establishes,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '5' ELSE 'r' || event_id END AS reasoning FROM events""",
}

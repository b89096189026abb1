"""DuckDB SQL for each of ``scoring_queries.QUERIES``."""

_PAGES = """
p AS (
  SELECT 'c/' || conv_id || '.pdf' AS file, (turn + 1)::INT AS page, CASE WHEN role = 'system' THEN ' ' || chr(10) ELSE text END AS text FROM conversations
  UNION ALL SELECT 'd/' || doc_id || '.txt', NULL, CASE WHEN lang = 'fr' THEN chr(9) || ' ' ELSE text END FROM documents
  UNION ALL SELECT 'r/' || r_regionkey || '.doc', NULL, r_name FROM region
  UNION ALL SELECT 'n/' || n_nationkey || '.pdf', CASE WHEN n_regionkey > 1 THEN 0 END, NULL FROM nation)"""
_ANSWERS = r"""
a AS (
  SELECT 'a' || c_custkey AS id, c_name AS answer, c_nationkey AS n, c_custkey AS k, CASE WHEN c_nationkey <> 4 THEN c_acctbal::DOUBLE END AS latency_ms,
    CASE c_mktsegment WHEN 'BUILDING' THEN ' corpus\d\' || c_custkey || '.aspx.txt' || chr(10) WHEN 'AUTOMOBILE' THEN 'c/' || c_nationkey || '.pdf'
      WHEN 'MACHINERY' THEN 'n/' || c_nationkey || '.pdf' WHEN 'HOUSEHOLD' THEN 'corpus/c/' || c_nationkey || '.pdf' END AS f1,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN (c_custkey % 6)::INT END AS p1,
    CASE WHEN c_nationkey < 12 THEN 'r/' || c_nationkey || '.doc' WHEN c_nationkey >= 22 THEN '  ' END AS f2
  FROM customer),
ci AS (
  SELECT id, 0 AS cite_pos, f1 AS raw, p1 AS page FROM a WHERE n <> 3 AND f1 IS NOT NULL
  UNION ALL SELECT id, (f1 IS NOT NULL)::INT, f2, NULL FROM a WHERE n <> 3 AND f2 IS NOT NULL)"""
_RESOLVED = r"""
h AS (
  SELECT file, (string_agg('[page ' || r || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY r) || CASE WHEN any_value(c) > 5 THEN chr(10) || chr(10) || '[truncated: ' || any_value(c) || ' pages total]' ELSE '' END)[1:6000] AS head
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page) AS r, count(*) OVER (PARTITION BY file) AS c FROM p WHERE page > 0) WHERE r <= 5 GROUP BY file),
k AS (SELECT file, max(page) AS last, max(text) FILTER (page IS NULL) AS whole, true AS known FROM p GROUP BY file),
n AS (SELECT *, replace(regexp_replace(replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\', '/'), '^corpus/', ''), '.aspx.txt', '.txt') AS rel FROM ci),
e AS (
  SELECT n.id, cite_pos, raw, rel, n.page, last, whole, head, s.text AS one,
    CASE WHEN rel = '' THEN 'missing file path' WHEN known IS NULL THEN 'file not found: ' || rel
      WHEN rel LIKE '%.txt' THEN CASE WHEN regexp_replace(coalesce(whole, ''), '\s', '', 'g') = '' THEN 'empty text file' END
      WHEN rel LIKE '%.pdf' THEN CASE WHEN last IS NULL THEN 'unreadable PDF' WHEN last = 0 THEN 'PDF has no pages' WHEN n.page IS NULL THEN NULL
        WHEN n.page < 1 OR n.page > last THEN 'page ' || n.page || ' out of range (1-' || last || ')'
        WHEN regexp_replace(coalesce(s.text, ''), '\s', '', 'g') = '' THEN 'page ' || n.page || ' is empty' END
      ELSE 'unsupported file type: ' || regexp_extract(rel, '(\.[^.]+)$', 1) END AS error
  FROM n LEFT JOIN k ON rel = k.file LEFT JOIN h ON rel = h.file LEFT JOIN (SELECT * FROM p WHERE page IS NOT NULL) s ON rel = s.file AND n.page = s.page),
r AS (
  SELECT *, error IS NULL AND regexp_replace(coalesce(text, ''), '\s', '', 'g') <> '' AS ok
  FROM (SELECT id, cite_pos, CASE WHEN rel = '' THEN raw ELSE rel END AS file, page, error, CASE WHEN error IS NULL THEN (CASE WHEN rel LIKE '%.txt' THEN whole WHEN page IS NULL THEN head ELSE one END)[1:6000] END AS text FROM e))"""
_SCORED = r"""
g AS (SELECT 'a' || c_custkey AS id, [1.0, 0.5, 0.0, 0.0][(c_custkey % 4)::INT + 1]::DOUBLE AS worth, ['fully', 'partially', 'not_at_all', 'not_at_all'][(c_custkey % 4)::INT + 1] AS grade FROM customer WHERE c_acctbal > 0),
t AS (
  SELECT id, count(*)::INT AS n, (count(*) FILTER (ok))::INT AS ok,
    string_agg(CASE WHEN ok THEN 'resolved ' || file || CASE WHEN coalesce(page, 0) <> 0 THEN ' p.' || page ELSE '' END ELSE 'invalid ' || file || ': ' || coalesce(error, 'None') END, '|' ORDER BY cite_pos) AS d FROM r GROUP BY id),
s AS (
  SELECT a.*, CASE WHEN t.n = t.ok THEN coalesce(worth, 0) ELSE 0 END::DOUBLE AS citation_score, CASE WHEN t.n = t.ok THEN grade ELSE 'not_at_all' END AS citation_establishes,
    coalesce(t.ok, 0) AS citation_resolved, coalesce(t.n, 0) AS citation_total, coalesce(t.n - t.ok, 0) AS citation_invalid,
    coalesce(d, 'no citations provided') || CASE WHEN t.n > t.ok THEN '|score=0 because at least one citation is invalid' WHEN t.n = t.ok AND grade IS NULL THEN '|citation judge skipped' ELSE '' END AS details,
    CASE WHEN t.n = t.ok AND grade IS NOT NULL THEN 0.25 ELSE 0 END::DOUBLE AS citation_cost_usd
  FROM a LEFT JOIN t USING (id) LEFT JOIN g USING (id))"""
_WITH = f"WITH {_PAGES},{_ANSWERS},{_RESOLVED},{_SCORED}"
_VERDICTS = """
v AS (SELECT 'a' || c_custkey AS id, c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AS relevant, c_custkey % 5 = 0 AS hallucination, c_custkey % 7 = 0 AS refusal, CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS cost,
  c_custkey % 2 = 0 AS said FROM customer WHERE c_nationkey <> 7)"""
_ROWS = f"""{_WITH},{_VERDICTS},
o AS (
  SELECT s.id, lower(c.c_mktsegment) AS domain, ['easy', 'medium', 'hard'][(c.c_custkey % 3)::INT + 1] AS difficulty, answer, latency_ms, citation_score, citation_establishes, relevant, hallucination, refusal,
    CASE WHEN v.id IS NOT NULL THEN 'why' END AS judge_reasoning, coalesce(cost, 0) + citation_cost_usd AS judge_cost_usd
  FROM s JOIN customer c ON s.k = c.c_custkey LEFT JOIN v USING (id))"""
_RATE = "coalesce(avg(CASE WHEN relevant IS NOT NULL THEN coalesce({0}, false)::INT::DOUBLE END), 0)"
_SOURCES = """
l AS (SELECT l_orderkey, l_returnflag, l_linenumber, 'n' || (l_suppkey % 7) || CASE WHEN l_linestatus = 'O' THEN '.pdf' ELSE '.PDF' END AS file, CASE WHEN l_quantity > 20 THEN l_quantity::INT END AS page FROM lineitem),
q AS (SELECT o_orderkey, 'q' || o_orderkey AS id, ['hard', 'medium', 'easy', 'easy', 'other'][o_orderpriority[1]::INT] AS difficulty, length(o_orderpriority) AS q_len, CASE WHEN o_totalprice > 150000 THEN 4 ELSE 5 END::BIGINT AS a_len, o_totalprice > 150000 AS has_number FROM orders),
m AS (SELECT l_orderkey, l_returnflag, bool_or(file IN ('n0.pdf', 'n2.pdf', 'n3.pdf', 'n5.pdf')) AS known FROM l GROUP BY ALL),
w AS (
  SELECT q.*, (SELECT count(DISTINCT l_returnflag) FROM l WHERE l_orderkey = o_orderkey)::INT AS num_groups, (SELECT count(*) FROM l WHERE l_orderkey = o_orderkey)::INT AS num_sources,
    (SELECT coalesce(bool_and(known), true) FROM m WHERE l_orderkey = o_orderkey) AS in_manifest FROM q)"""
_BENCH = "SELECT 'q' || item_id AS id, item_id, text FROM benchmark"
_LABELS = [
    ("apartment", "Apartment"), ("business", "Business"), ("car", "Car"), ("dental", "Dental"), ("diseases-disabilities", "Diseases & Disabilities"), ("health", "Health"), ("life", "Life"),
    ("long-term-care", "Long-Term Care"), ("loss-of-working-ability", "Loss of Working Ability"), ("mortgage", "Mortgage"), ("personal-accident", "Personal Accident"), ("travel", "Travel"),
]
_RULE = "=" * 60
_PART = f"'{_RULE}' || chr(10) || '[{{0}}] {{1}}' || chr(10) || '{_RULE}' || chr(10) || {{2}} || chr(10)"
_FILE = r"'\xC3(\xEF\xBF\xBD \xFF'"

ORACLE = {
    "citation_resolution": f"WITH {_PAGES},{_ANSWERS},{_RESOLVED} SELECT id, cite_pos::INT AS cite_pos, file, page, error, ok, md5(text) AS md5, length(text) AS n FROM r",
    "citation_scores": f"{_WITH} SELECT id, citation_score, citation_establishes, citation_resolved, citation_total, citation_invalid, citation_cost_usd, details FROM s",
    "scored_rows": f"{_ROWS} SELECT * FROM o",
    "scored_by_domain": f"""{_ROWS} SELECT domain, count(*) AS count, {_RATE.format('relevant')} AS relevance_rate, {_RATE.format('hallucination')} AS hallucination_rate, {_RATE.format('refusal')} AS refusal_rate,
  avg(citation_score) AS citation_accuracy, coalesce(avg(latency_ms), 0) AS latency_ms_avg FROM o GROUP BY domain""",
    "runs_by_label": f"""WITH {_PAGES},{_ANSWERS},{_RESOLVED},{_VERDICTS},
x AS (SELECT 'one' AS run_label, id, answer, said AS relevant, hallucination, refusal, CASE WHEN refusal THEN 0.5::DOUBLE END AS stored, true AS has FROM a LEFT JOIN v USING (id)
  UNION ALL SELECT 'two', id, CASE WHEN latency_ms > 0 THEN answer ELSE '(missing)' END, NULL, NULL, NULL, NULL, latency_ms > 0 FROM a)
SELECT run_label, id, relevant, CASE WHEN relevant IS NULL THEN 'missing' WHEN refusal THEN 'refusal' WHEN hallucination THEN 'hallucination' WHEN relevant THEN 'relevant' ELSE 'wrong' END AS outcome,
  CASE WHEN stored IS NOT NULL THEN stored WHEN has THEN 0::DOUBLE END AS citation_score, length(answer) AS answer_len FROM x""",
    "embedded_payload": "SELECT 'a' || c_custkey AS id, c_name AS answer, ['easy', 'medium', 'hard'][(c_custkey % 3)::INT + 1] AS difficulty, 'missing' AS outcome FROM customer",
    "question_rows": f"""WITH {_SOURCES}
SELECT id, q_len, a_len, num_groups, num_sources, has_number, coalesce(x.null_pages, 0)::INT AS null_pages, in_manifest, coalesce(x.kinds, '') AS kinds, coalesce(x.pages, 0)::INT AS pages
FROM w LEFT JOIN (SELECT l_orderkey, count(*) FILTER (page IS NULL) AS null_pages, sum(page) AS pages, string_agg(CASE WHEN file LIKE '%.pdf' THEN 'pdf' ELSE 'txt' END, ',' ORDER BY l_returnflag, l_linenumber, file, page NULLS FIRST) AS kinds FROM l GROUP BY l_orderkey) x ON l_orderkey = o_orderkey""",
    "citation_mix": f"""WITH {_SOURCES}
SELECT difficulty, coalesce(sum(x.pdf), 0)::BIGINT AS pdf, coalesce(sum(x.txt), 0)::BIGINT AS txt, count(*) FILTER (num_groups > 1) AS multi_group
FROM w LEFT JOIN (SELECT l_orderkey, count(*) FILTER (file LIKE '%.pdf') AS pdf, count(*) FILTER (file NOT LIKE '%.pdf') AS txt FROM l GROUP BY l_orderkey) x ON l_orderkey = o_orderkey WHERE difficulty <> 'other' GROUP BY difficulty""",
    "missing_files": f"WITH {_SOURCES} SELECT DISTINCT file, length(file) AS n FROM l JOIN orders ON l_orderkey = o_orderkey WHERE file NOT IN ('n0.pdf', 'n2.pdf', 'n3.pdf', 'n5.pdf')",
    "distinct_sources": f"""WITH {_SOURCES}
SELECT file, CASE WHEN file LIKE '%.pdf' THEN 'pdf' ELSE 'txt' END AS cited_kind, 'pdf' AS kind FROM (SELECT file FROM l JOIN orders ON l_orderkey = o_orderkey UNION SELECT unnest(['n0.pdf', 'n2.pdf', 'n3.pdf', 'n5.pdf']))""",
    "answer_matches": f"""WITH {_SOURCES},
c AS (SELECT l_orderkey, 'n' || min(l_suppkey % 7) || '.pdf' AS cite FROM lineitem GROUP BY l_orderkey),
y AS (SELECT l.l_orderkey, l_returnflag, (list(file) FILTER (file = cite AND (page IS NULL OR page = 30)))[1] AS met, '[' || string_agg('''' || file || '''', ', ' ORDER BY l_linenumber, file, page NULLS FIRST) || ']' AS wanted FROM l LEFT JOIN c USING (l_orderkey) GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS i FROM y),
b AS (SELECT l_orderkey, count(*) AS total, count(met) AS hits, string_agg('group ' || i || coalesce(': reference hit (' || met || ')', ': reference miss (expected one of ' || wanted || ')'), '|' ORDER BY i) AS d FROM z GROUP BY l_orderkey)
SELECT id, CASE WHEN total IS NULL THEN 1 ELSE hits::DOUBLE / total END::DOUBLE AS legacy_score, CASE WHEN total IS NULL OR hits = total THEN 'fully' WHEN hits > 0 THEN 'partially' ELSE 'not_at_all' END AS legacy_establishes,
  coalesce(hits, 0)::INT AS legacy_resolved, coalesce(total, 0)::INT AS legacy_total, coalesce(total - hits, 0)::INT AS legacy_invalid, coalesce(d, 'no reference sources listed') AS details
FROM q LEFT JOIN b ON l_orderkey = o_orderkey""",
    "corpus_files": r"""
WITH f AS (SELECT split_part(regexp_replace(url, '^https?://', ''), '?', 1) || '.Pdf' AS rel, url, length(html) AS n FROM pages)
SELECT rel, split_part(rel, '/', 1) AS domain, split_part(rel, '/', 2) AS subdir, CASE WHEN rel LIKE '%/.Pdf' THEN 'other' ELSE 'pdf' END AS kind, CASE WHEN contains(url, '.org') THEN 'org' WHEN contains(url, '/en/') THEN 'english' ELSE 'else' END AS host,
  split_part(rel, '/', -1) AS name, (SELECT max(n) FROM f g WHERE g.rel = f.rel) AS size FROM f""",
    "corpus_profile": """
WITH f AS (SELECT ['car', 'life', 'long-term-care', 'x'][(s_suppkey % 4)::INT + 1] AS domain, s_nationkey > 9 AS pdf FROM supplier)
SELECT domain, count(*) FILTER (pdf) AS pdf, count(*) FILTER (NOT pdf) AS txt, ['Car', 'Life', 'Long-Term Care', 'x'][list_position(['car', 'life', 'long-term-care', 'x'], domain)] AS label FROM f GROUP BY domain""",
    "page_profile": f"""WITH {_PAGES}, c AS (SELECT file, coalesce(max(page), 0) AS n FROM p WHERE file LIKE '%.pdf' GROUP BY file)
SELECT avg(nullif(n, 0)::DOUBLE) AS pages_avg, percentile_disc(0.5) WITHIN GROUP (ORDER BY nullif(n, 0) DESC)::DOUBLE AS pages_p50, count(nullif(n, 0)) AS readable FROM c""",
    "keyword_classes": """
WITH k(i, needle, label) AS (VALUES (0, 'פוליס', 'Policy (פוליס)'), (1, 'תנאי', 'Terms (תנאי)'), (2, 'טופס', 'Form (טופס)'), (3, 'חוברת', 'Booklet (חוברת)'), (4, 'הודעה', 'Notice (הודעה)'),
  (5, 'מידע', 'Material info (מידע)'), (6, 'נוהל', 'Procedure (נוהל)'), (7, 'תצהיר', 'Affidavit (תצהיר)'), (8, 'כתב', 'Deed/charter (כתב)'))
SELECT label, count(*) AS n FROM part JOIN k ON p_partkey % 9 = i OR (p_size > 25 AND i = 2) GROUP BY label""",
    "questions_file": f"""
SELECT form, id, item_id::BIGINT AS pos, md5(CASE WHEN form = 'held' AND item_id = 3 THEN 'again' ELSE text END) AS md5, text[1:9] AS ground_truth_answer, item_id::INT AS page FROM ({_BENCH}), (VALUES ('held'), ('bare')) f(form)""",
    "examples_file": f"""
WITH e AS (SELECT r_regionkey AS k, r_name AS u, lower(r_name) || CASE WHEN r_regionkey > 1 THEN chr(10) || chr(10) || 'מקורות:' || chr(10) || '- f.pdf' || CASE WHEN r_regionkey > 2 THEN ', עמוד ' || r_regionkey ELSE '' END ELSE '' END AS b FROM region),
s AS (SELECT string_agg({_PART.format("' || (2 * k + 1) || '", "USER", "u")} || chr(10) || {_PART.format("' || (2 * k + 2) || '", "ASSISTANT", "b")}, chr(10) ORDER BY k) AS shots, count(*) AS c FROM e)
SELECT id, (2 * c + 2)::INT AS n, md5({_PART.format("0", "SYSTEM", "'Answer.'")} || chr(10) || shots || chr(10) || {_PART.format("' || (2 * c + 1) || '", "USER", "text")}) AS md5 FROM ({_BENCH}), s""",
    "answers_log": f"""
SELECT 'run' AS run_label, id, (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS pos, md5(text || CASE WHEN item_id < 5 THEN '2' ELSE '0' END) AS md5, item_id::DOUBLE AS latency_ms FROM ({_BENCH})""",
    "log_preset": """
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'given' END AS explicit, ['baseline', 'no-cite', 'no-cite', 'concise', 'default', 'default', 'baseline', 'baseline'][(o_orderkey % 8)::INT + 1] AS told FROM orders)
SELECT o_orderkey, coalesce(explicit, told) AS by_label, coalesce(explicit, 'default') AS preset,
  CASE coalesce(explicit, told) WHEN 'default' THEN 'examples.json' WHEN 'concise' THEN 'examples.json' WHEN 'no-cite' THEN 'examples_no_cite.json' ELSE 'none' END AS examples FROM x""",
    "resumed_log": f"""
SELECT id, md5(CASE WHEN item_id < 7 THEN upper(text) ELSE '' END) AS md5, CASE WHEN item_id < 7 THEN 'concise' END AS preset, CASE WHEN item_id < 7 THEN 'e.json' END AS examples_file,
  CASE WHEN item_id < 7 THEN 10 END AS few_shot_examples, CASE WHEN item_id >= 7 THEN 'HTTP 500' END AS endpoint_error FROM ({_BENCH})""",
    "streamed_log": f"SELECT id, md5(CASE WHEN item_id < 5 THEN 'old' ELSE lower(text) END) AS md5 FROM ({_BENCH})",
    "report_file": f"SELECT id, md5(text) AS md5, item_id::DOUBLE AS latency_ms, 0::DOUBLE AS citation_score, 'not_at_all' AS citation_establishes, NULL::BOOLEAN AS relevant FROM ({_BENCH})",
    "console_summary": f"""{_ROWS},
z AS (SELECT count(*) AS total, {_RATE.format('relevant')} AS a, {_RATE.format('hallucination')} AS b, {_RATE.format('refusal')} AS c, avg(citation_score) AS d, avg(latency_ms) AS l, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms DESC)::DOUBLE AS m, sum(judge_cost_usd) AS j FROM o),
y AS (SELECT difficulty, count(*) AS n, {_RATE.format('relevant')} AS a, {_RATE.format('hallucination')} AS b, avg(citation_score) AS d, row_number() OVER (ORDER BY difficulty) AS i FROM o GROUP BY difficulty)
SELECT i::BIGINT AS i, line FROM (
  SELECT 0 AS i, 'Run: all' AS line UNION ALL SELECT 1, 'Questions: ' || total FROM z UNION ALL SELECT 2, printf('Relevance: %.1f%%', a * 100) FROM z UNION ALL SELECT 3, printf('Hallucination: %.1f%%', b * 100) FROM z
  UNION ALL SELECT 4, printf('Refusal: %.1f%%', c * 100) FROM z UNION ALL SELECT 5, printf('Citation accuracy: %.1f%%', d * 100) FROM z UNION ALL SELECT 6, printf('Latency: mean %.0f ms, median %.0f ms', l, m) FROM z
  UNION ALL SELECT 7, printf('Judge cost: $%.4f', j) FROM z UNION ALL SELECT 7 + i, printf('%s (%d): relevance %.0f%%, hallucination %.0f%%, citation %.0f%%', difficulty, n, a * 100, b * 100, d * 100) FROM y)""",
    "manifest_file": "SELECT 'x/' || n_name || '.pdf' AS rel, 'http://h/' || n_nationkey AS url, 'x' AS domain, 'pdf' AS kind, n_name || '.pdf' AS name FROM nation",
    "file_texts": """
SELECT n_nationkey AS k, md5(n_name || '�(� �' || CASE WHEN n_nationkey > 9 THEN 'é' || chr(12) || '2' ELSE '�' END || chr(10)) AS replaced, md5(n_name || '(� ' || CASE WHEN n_nationkey > 9 THEN 'é' || chr(12) || '2' ELSE '' END || chr(10)) AS dropped,
  (length(n_name) + 7 + CASE WHEN n_nationkey > 9 THEN 4 ELSE 2 END + 1)::BIGINT AS size FROM nation""",
    "pdf_text": """
SELECT n_nationkey AS k, 1 AS page, md5(n_name || '(� é') AS md5 FROM nation WHERE n_nationkey > 9 UNION ALL SELECT n_nationkey, 2, md5('2' || chr(10)) FROM nation WHERE n_nationkey > 9
UNION ALL SELECT n_nationkey, NULL, NULL FROM nation WHERE n_nationkey <= 9""",
    "judge_prompt": f"""WITH {_PAGES},{_ANSWERS},{_RESOLVED},
b AS (SELECT id, string_agg('--- Citation ' || i || ': ' || file || CASE WHEN coalesce(page, 0) <> 0 THEN ' (page ' || page || ')' ELSE '' END || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cite_pos) AS i FROM r WHERE ok) GROUP BY id)
SELECT id, md5('Question: ' || '{{answer}}' || chr(10) || 'Answer: ' || CASE WHEN answer LIKE '%0' THEN '(empty answer)' ELSE answer END || chr(10) || chr(10) || coalesce(x, '')) AS md5 FROM a LEFT JOIN b USING (id)""",
    "reply_verdicts": """
SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id % 2 = 1 AND event_id % 3 <> 0 END AS relevant, CASE WHEN event_id % 11 <> 0 THEN event_id % 3 = 0 END AS hallucination, CASE WHEN event_id % 11 <> 0 THEN false END AS refusal,
  CASE WHEN event_id % 11 <> 0 THEN 'r' || event_id END AS reasoning, event_id % 30 <= 20 AS in_range FROM events""",
    "stored_grades": """
SELECT o_orderkey, ['fully', 'partially', 'not_at_all', 'not_at_all', 'not_at_all'][o_orderpriority[1]::INT] AS grade, [1.0, 0.5, 0.0, 0.0, 0.0][o_orderpriority[1]::INT]::DOUBLE AS score, c_acctbal
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""",
    "endpoint_call": "SELECT item_id, text[1:20] AS answer, (length(text)::DOUBLE * 0.5::DOUBLE + 20::DOUBLE * 2.0::DOUBLE) / 1e6::DOUBLE AS cost_usd FROM benchmark",
    "prompt_specs": """
SELECT * FROM (VALUES ('spec', 'default', 'default.md', 'e.json', 22::BIGINT), ('spec', 'concise', 'concise.md', NULL, 2), ('spec', 'no-cite', 'no-cite.md', NULL, 2), ('label', 'Few Shot', 'reports/a_answers.jsonl', NULL, 0),
  ('label', 'Baseline', 'b.jsonl', NULL, 1), ('label', 'no-cite.eval', 'runs/no-cite.eval.json', NULL, 2), ('label', 'a', 'b|c', NULL, 3), ('model', 'prov/m', 'http://m/ask', NULL, NULL), ('model', 'prov/m', 'http://prov/m/ask', NULL, NULL)) t(what, a, b, c, n)""",
    "sort_keys": """
SELECT doc_id::VARCHAR AS by_id, source AS by_domain, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE -1 END::INT AS by_difficulty,
  CASE WHEN quality IS NULL THEN 'missing' WHEN quality + toxic = 0 THEN 'refusal' WHEN toxic = 1 THEN 'hallucination' ELSE 'relevant' END AS by_outcome,
  coalesce(quality, 0)::INT AS by_relevant, coalesce(toxic, 0)::INT AS by_hallucination, coalesce(quality + toxic = 0, false)::INT AS by_refusal, CASE WHEN quality = 1 THEN 0.5 ELSE 0 END::DOUBLE AS by_citation,
  CASE WHEN toxic = 0 THEN doc_id ELSE 0 END::DOUBLE AS by_latency, CASE WHEN quality IS NULL THEN 0 ELSE doc_id + CASE WHEN toxic = 0 THEN 5 ELSE 0 END END::BIGINT AS by_tokens, doc_id::VARCHAR AS by_what
FROM documents LEFT JOIN labels USING (doc_id)""",
    "unit_columns": """
SELECT l_orderkey, l_linenumber, l_discount * 100.0::DOUBLE AS percent, l_extendedprice / 1024.0::DOUBLE AS kb, l_extendedprice / 1048576.0::DOUBLE AS mb, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_quantity / (l_linenumber - 3)::DOUBLE END::DOUBLE AS ratio,
  greatest(least(l_extendedprice, 30000.0::DOUBLE), 1000.0::DOUBLE) AS clamped, (l_linenumber % 3)::INT AS color FROM lineitem""",
    "titled": f"""
WITH k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{b}')" for i, (_, b) in enumerate(_LABELS))}, (12, 'a-new_code')) t(i, label))
SELECT o_orderkey, array_to_string(list_transform(string_split(lower(o_orderpriority), '-'), lambda s: array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1]) || w[2:]), ' ')), '-') AS title, label,
  '&lt;"a" &amp; ''b''&gt;<br>' || o_orderpriority AS page FROM orders JOIN k ON o_orderkey % 13 = i""",
    "cited_answers": f"""WITH {_ANSWERS}
SELECT a.id, md5(answer || coalesce(chr(10) || chr(10) || 'מקורות:' || chr(10) || x, '')) AS md5 FROM a LEFT JOIN (SELECT id, string_agg('- ' || raw || coalesce(', עמוד ' || page, ''), chr(10) ORDER BY cite_pos) AS x FROM ci GROUP BY id) USING (id)""",
    "first_questions": "SELECT 'a' || c_custkey AS id, lower(c_mktsegment) AS domain, c_custkey::BIGINT AS pos, asked::INT AS asked FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer), (VALUES (1), (3)) t(asked) WHERE r <= asked",
    "metric_rates": f"""WITH {_ANSWERS}
SELECT lower(c_mktsegment) AS domain, coalesce(avg((greatest(coalesce(latency_ms, 0), 0) <> 0)::INT::DOUBLE) FILTER (k % 3 = 0), 0) AS easy, coalesce(avg((greatest(coalesce(latency_ms, 0), 0) <> 0)::INT::DOUBLE) FILTER (k % 3 = 1), 0) AS medium,
  coalesce(avg((greatest(coalesce(latency_ms, 0), 0) <> 0)::INT::DOUBLE) FILTER (k % 3 = 2), 0) AS hard FROM a JOIN customer ON k = c_custkey GROUP BY 1""",
}

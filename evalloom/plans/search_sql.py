"""DuckDB SQL for each of ``search_queries.QUERIES``: every question against every document."""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE = {
    "text_search": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, sum(len(w)) / count(*)::DOUBLE AS mean FROM d),
t AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(l)::DOUBLE AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*)::DOUBLE AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
r AS (
  SELECT item_id, doc_id, sum(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l / mean)) * 1000000)::BIGINT)::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS place FROM r) WHERE place <= 10""",
}

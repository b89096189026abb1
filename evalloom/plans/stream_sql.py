"""DuckDB SQL for each of ``stream_queries.QUERIES``: what the streams give in the end, from the whole tables."""

_EVENTS = """
a AS (SELECT *, round(value * 100)::BIGINT AS cents, ts + to_seconds(CASE WHEN event_id % 20 = 0 THEN 259200 ELSE event_id * 37 % 3600 END) AS arrival FROM events),
o AS (SELECT * FROM a WHERE arrival <= ts + INTERVAL 1 DAY),
w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM o)"""
_TOLD = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

ORACLE = {
    "tumbling_windows": f"""
WITH {_EVENTS}, h AS (SELECT date_trunc('hour', ts) AS s, * FROM o)
SELECT {_TOLD.format("s")} AS window_start, {_TOLD.format("s + INTERVAL 1 HOUR")} AS window_end, event_type, count(*) AS n, sum(cents)::BIGINT AS cents
FROM h, w WHERE s + INTERVAL 1 HOUR <= mark GROUP BY s, event_type""",
    "sliding_windows": f"""
WITH {_EVENTS}, h AS (SELECT time_bucket(INTERVAL 2 HOURS, ts) - k * INTERVAL 2 HOURS AS s, event_type, cents FROM o, range(3) r(k))
SELECT {_TOLD.format("s")} AS window_start, {_TOLD.format("s + INTERVAL 6 HOURS")} AS window_end, event_type, count(*) AS n, max(cents) AS most
FROM h, w WHERE s + INTERVAL 6 HOURS <= mark GROUP BY s, event_type""",
    "session_windows": f"""
WITH {_EVENTS},
g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM o),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
e AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOURS AS b, count(*) AS n, sum(cents)::BIGINT AS cents FROM s GROUP BY user_id, k)
SELECT {_TOLD.format("a")} AS window_start, {_TOLD.format("b")} AS window_end, user_id, n, cents FROM e, w WHERE b <= mark""",
    "late_events": f"""
WITH {_EVENTS} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM a WHERE arrival > ts + INTERVAL 1 DAY GROUP BY ALL""",
    "call_outcomes": """
WITH r AS (SELECT *, row_number() OVER p AS k, lag(o_orderdate) OVER p AS before, lead(o_orderdate) OVER p AS next FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
b AS (SELECT *, count(*) FILTER (o_orderdate > before + INTERVAL 365 DAYS) OVER (PARTITION BY o_custkey ORDER BY k) AS broken FROM r),
f AS (
  SELECT o_custkey, min(k) FILTER (o_orderpriority = '1-URGENT') AS ok, max(k) AS n, max(o_orderdate) AS last, arg_max(next, k) AS next
  FROM b WHERE broken = 0 AND k <= 3 GROUP BY o_custkey)
SELECT o_custkey::VARCHAR AS id, CASE WHEN ok IS NOT NULL THEN 'answered' WHEN n = 3 THEN 'failed' ELSE 'given up' END AS outcome, coalesce(ok, n)::INT AS attempts,
  CASE WHEN ok IS NOT NULL THEN '1-URGENT' END AS answer
FROM f WHERE ok IS NOT NULL OR n = 3 OR next IS NOT NULL OR last + INTERVAL 365 DAYS <= (SELECT max(o_orderdate) FROM orders)""",
}

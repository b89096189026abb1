"""DuckDB SQL for each of ``analytic_queries.QUERIES``. What sketches estimate is given exactly, and as within the stated error."""

ORACLE = {
    "sketched_days": """
WITH e AS (SELECT event_type, unnest(['all', ts::DATE::VARCHAR]) AS day, user_id FROM events)
SELECT event_type, day, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within, true AS p90_within FROM e GROUP BY ALL""",
    "counted_users": """
SELECT event_type, count(*) AS users, sum(n)::BIGINT AS n, true AS never_below, true AS "within"
FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""",
    "local_days": """
WITH e AS (SELECT ts + to_days((event_id % 337)::INT) AS ts, ['Europe/Berlin', 'America/New_York', 'Asia/Tokyo'][event_id % 3 + 1] AS zone, round(value * 100)::BIGINT AS cents FROM events),
d AS (SELECT zone, timezone(zone, timezone('UTC', ts))::DATE AS day, cents FROM e),
g AS (SELECT zone, day, count(*) AS n, sum(cents)::BIGINT AS cents FROM d GROUP BY ALL)
SELECT zone, day::VARCHAR AS local_day, (epoch(timezone(zone, (day + 1)::TIMESTAMP)) - epoch(timezone(zone, day::TIMESTAMP))) / 3600 AS day_hours, n, cents FROM g""",
    "moving_sums": """
WITH e AS (SELECT event_id, event_type, ts, round(value * 100)::BIGINT AS cents FROM events)
SELECT event_id, event_type, cents, sum(cents) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS hour_cents FROM e""",
    "exact_revenue": """
WITH r AS (SELECT l_returnflag, l_linestatus, round(l_extendedprice::VARCHAR::DECIMAL(18, 2) * (1 - l_discount::VARCHAR::DECIMAL(4, 2)), 2)::DECIMAL(18, 2) AS net FROM lineitem),
g AS (SELECT l_returnflag, l_linestatus, count(net) AS n, sum(net)::DECIMAL(38, 2) AS revenue FROM r GROUP BY ALL),
c AS (SELECT *, (revenue * 100)::HUGEINT AS cents, sum((revenue * 100)::HUGEINT) OVER () AS total FROM g),
w AS (SELECT *, (cents * 10000 * 2 + n * 100) // (n * 200) AS m, (cents * 1000000 * 2 + total) // (total * 2) AS s FROM c)
SELECT l_returnflag, l_linestatus, n, revenue::VARCHAR AS revenue, (m::DECIMAL(28, 0) * 0.0001)::DECIMAL(28, 4)::VARCHAR AS mean, (s::DECIMAL(28, 0) * 0.000001)::DECIMAL(28, 6)::VARCHAR AS share FROM w""",
}

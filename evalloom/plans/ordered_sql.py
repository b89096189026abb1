"""DuckDB SQL for each of ``ordered_queries.QUERIES``."""

ORACLE = {
    "asof_last_view": """
WITH v AS (SELECT user_id, ts, max(event_id) AS view_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, e.user_id, e.event_type, v.view_id, v.value FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""",
    "asof_hot_key": """
WITH h AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM events),
v AS (SELECT user_id, ts, max(event_id) AS view_id FROM h WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, e.user_id, v.view_id FROM h e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""",
    "interval_join": """
WITH r AS (SELECT event_id AS error_id, user_id, ts AS low, ts + to_minutes(10 * round(value)::BIGINT) AS high FROM events WHERE event_type = 'error')
SELECT error_id, event_id, e.user_id FROM events e JOIN r ON e.user_id = r.user_id AND e.ts BETWEEN low AND high""",
    "band_join": """
WITH b AS (SELECT p_partkey, (p_retailprice - 900) * 100 AS low, (p_retailprice - 900) * 100 + pow(2.0, p_size) / 100 AS high FROM part WHERE p_size <= 10)
SELECT p_partkey, c_custkey FROM customer JOIN b ON c_acctbal BETWEEN low AND high""",
}

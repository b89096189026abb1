"""Registered queries of streams. Keys are those of ``stream_sql.ORACLE``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import attempts, windows

#: Minutes after which an event is late.
ALLOWED = 1440


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark, sf):
    """Events as they come in: within an hour, one in twenty three days later."""
    lag = F.when(F.col("event_id") % 20 == 0, 259200).otherwise(F.col("event_id") * 37 % 3600)
    rows = _t(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    rows = rows.withColumn("arrival", F.col("ts") + F.make_dt_interval(secs=lag.cast("decimal(18,6)")))
    return windows.landed_stream(spark, *windows.land(rows, "arrival"), rows.schema)


def _told(c):
    return F.col(c).cast("timestamp_ntz").cast("string").substr(1, 19)


def _closed(stream, name):
    rows, _ = windows.to_table(stream, name)
    return rows.withColumns({"window_start": _told("window.start"), "window_end": _told("window.end")}).drop("window")


def tumbling_windows(spark, sf):
    rows = windows.on_time(_events(spark, sf), "ts", "arrival", ALLOWED)
    return _closed(windows.tumbling(rows, "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.sum("cents").alias("cents")), "tumbling")


def sliding_windows(spark, sf):
    rows = windows.on_time(_events(spark, sf), "ts", "arrival", ALLOWED)
    return _closed(windows.sliding(rows, "ts", "6 hours", "2 hours", ["event_type"], F.count("*").alias("n"), F.max("cents").alias("most")), "sliding")


def session_windows(spark, sf):
    rows = windows.on_time(_events(spark, sf), "ts", "arrival", ALLOWED)
    return _closed(windows.sessions(rows, "ts", "6 hours", ["user_id"], F.count("*").alias("n"), F.sum("cents").alias("cents")), "sessions")


def late_events(spark, sf):
    """Late rows are a table of their own, counted by the day of the event."""
    stream = _events(spark, sf)
    rows, _ = windows.to_table(stream.where(windows.late("ts", "arrival", ALLOWED)), "late")
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def call_outcomes(spark, sf):
    """A customer's orders as attempts at one call, of which urgent ones succeed; every seventh is delivered again later."""
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("seq"), (F.col("o_orderpriority") == "1-URGENT").alias("ok"), F.col("o_orderpriority").alias("answer"))
    again = orders.where("seq % 7 = 0").withColumn("arrival", F.col("at") + F.make_dt_interval(days=F.lit(200)))
    rows = orders.withColumn("arrival", F.col("at")).unionByName(again)
    stream = windows.landed_stream(spark, *windows.land(rows, "arrival", 4), rows.schema)
    found, _ = attempts.with_rocks(windows.to_table)(attempts.outcomes(stream.drop("arrival"), tries=3, patience_days=365), "outcomes")
    return found


QUERIES = {f.__name__: f for f in (tumbling_windows, sliding_windows, session_windows, late_events, call_outcomes)}

"""Registered queries of joins by order. Keys are those of ``ordered_sql.ORACLE``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def asof_last_view(spark, sf):
    """Each event with the user's last view at or before it."""
    events = _t(spark, sf, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), "value")
    out = ordered.asof_join(events.select("event_id", "user_id", "ts", "event_type"), views, "user_id", "ts", "seen", ["view_id", "value"], "view_id")
    return out.select("event_id", "user_id", "event_type", F.col("found.view_id").alias("view_id"), F.col("found.value").alias("value"))


def asof_hot_key(spark, sf):
    """As above with a third of all events under one user."""
    hot = _t(spark, sf, "events").withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id")))
    views = hot.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    out = ordered.asof_join(hot.select("event_id", "user_id", "ts"), views, "user_id", "ts", "seen", ["view_id"], "view_id")
    return out.select("event_id", "user_id", F.col("found.view_id").alias("view_id"))


def interval_join(spark, sf):
    """Events of a user inside the hours after each of the user's errors; a period is as long as its error's value in minutes, times ten."""
    events = _t(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("at").alias("low"), (F.col("at") + F.round("value").cast("bigint") * 600_000_000).alias("high"))
    out = ordered.range_join(events.select("event_id", "user_id", "at"), errors, "at", "low", "high", ["user_id"])
    return out.select("error_id", "event_id", "user_id")


def band_join(spark, sf):
    """Customers' balances inside bands around prices; bands have lengths of 0.01 to a thousand times as much."""
    bands = _t(spark, sf, "part").where("p_size <= 10").select("p_partkey", (F.col("p_retailprice") - 900).alias("a"), "p_size").select("p_partkey", (F.col("a") * 100).alias("low"), (F.col("a") * 100 + F.pow(F.lit(2.0), F.col("p_size")) / 100).alias("high"))
    out = ordered.range_join(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal", "low", "high")
    return out.select("p_partkey", "c_custkey")


QUERIES = {f.__name__: f for f in (asof_last_view, asof_hot_key, interval_join, band_join)}

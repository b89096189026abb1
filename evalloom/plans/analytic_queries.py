"""Registered queries of sketches, local time and exact money. Keys are those of ``analytic_sql.ORACLE``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import local_time, sketches
from ..sources.workspace import written


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sketched_days(spark, sf):
    """Users and values of events by day and kind, and rolled up by kind from the stored sketches, held against exact figures."""
    events = _t(spark, sf, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), "user_id", "value")
    stored = written(sketches.summarised(events, ["event_type", "day"], "user_id", "value"), "sketches")
    both = stored.unionByName(sketches.rolled_up(stored, ["event_type"]).withColumn("day", F.lit("all")))
    read = both.select("event_type", "day", "n", sketches.distinct_estimate().alias("users_near"), *[sketches.quantile_estimate(r).alias(f"q{int(100 * r)}") for r in (0.5, 0.9)])
    twice = events.withColumn("day", F.explode(F.array(F.col("day"), F.lit("all")))).join(read.drop("n"), ["event_type", "day"])
    ranks = [F.sum((F.col("value") <= F.col(q)).cast("int")).alias(f"{q}_up") for q in ("q50", "q90")] + [F.sum((F.col("value") < F.col(q)).cast("int")).alias(f"{q}_low") for q in ("q50", "q90")]
    exact = twice.groupBy("event_type", "day").agg(F.count_distinct("user_id").alias("users"), F.count("value").alias("valued"), F.first("users_near").alias("users_near"), *ranks)
    share = lambda q, r: (F.col(f"{q}_up") >= (r - sketches.RANK_ERROR) * F.col("valued") - 1) & (F.col(f"{q}_low") <= (r + sketches.RANK_ERROR) * F.col("valued") + 1)
    near = F.abs(F.col("users_near") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users") + 0.5
    return read.select("event_type", "day", "n").join(exact, ["event_type", "day"]).select("event_type", "day", "n", "users", near.alias("users_within"), share("q50", 0.5).alias("median_within"), share("q90", 0.9).alias("p90_within"))


def counted_users(spark, sf):
    """Events of each user and kind by a count-min sketch, rolled up from days, held against exact counts and its bound."""
    events = _t(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    stored = sketches.merged_counts(written(sketches.count_min(events, ["event_type", "day"], "user_id"), "counts"), ["event_type"])
    exact = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    found = sketches.estimated_counts(stored, exact.select("event_type", "user_id"), ["event_type"], "user_id").join(exact, ["event_type", "user_id"])
    totals = exact.groupBy("event_type").agg(F.sum("n").alias("total"))
    off = F.col("estimate") - F.col("n")
    out = found.join(totals, "event_type").groupBy("event_type").agg(F.count("*").alias("users"), F.sum("n").alias("n"), F.min(off >= 0).alias("never_below"), (F.avg((off > 2 * F.col("total") / sketches.WIDTH).cast("int")) <= 2.0**-sketches.DEPTH).alias("within"))
    return out.select("event_type", "users", "n", "never_below", "within")


def local_days(spark, sf):
    """Events by local day in three zones over a year with both changes of the clock."""
    k = F.col("event_id")
    zone = F.element_at(F.array(*map(F.lit, ["Europe/Berlin", "America/New_York", "Asia/Tokyo"])), (k % 3 + 1).cast("int"))
    events = _t(spark, sf, "events").select((F.col("ts") + F.make_dt_interval(days=(k % 337).cast("int"))).alias("ts"), zone.alias("zone"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    days = local_time.local_days(events, "ts", "zone")
    return days.groupBy("zone", F.col("local_day").cast("string").alias("local_day"), "day_hours").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def moving_sums(spark, sf):
    """For each event the sum of the kind's values over the hour up to it; five kinds, so each is a hot key."""
    events = _t(spark, sf, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return local_time.moving_sum(events, "event_type", "ts", "cents", 3600, "hour_cents").select("event_id", "event_type", "cents", "hour_cents")


def exact_revenue(spark, sf):
    """Revenue of line items by flag and status as exact decimals: sum, mean and share of all, printed half up."""
    price, rate = money.amount("l_extendedprice"), money.amount("l_discount")
    rows = _t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.round(price * (1 - rate), 2).cast("decimal(18,2)").alias("net"))
    groups = rows.groupBy("l_returnflag", "l_linestatus").agg(money.exact_sum(F.col("net")).alias("revenue"), F.count("net").alias("n"))
    total = groups.agg(money.exact_sum(F.col("revenue")).alias("total"))  # one row
    mean, share = money.exact_ratio(F.col("revenue"), F.col("n"), 4), money.exact_ratio(F.col("revenue"), F.col("total"), 6)
    return groups.join(F.broadcast(total), F.lit(True)).select("l_returnflag", "l_linestatus", "n", F.col("revenue").cast("string").alias("revenue"), mean.cast("decimal(28,4)").cast("string").alias("mean"), share.cast("decimal(28,6)").cast("string").alias("share"))


QUERIES = {f.__name__: f for f in (sketched_days, counted_users, local_days, moving_sums, exact_revenue)}

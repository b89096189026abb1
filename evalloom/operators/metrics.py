"""Metrics of runs, overall and by group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import mean, mean_truthy, or_zero, rate
from ..sources.constants import DIFFICULTIES

#: Accuracy of the sketch that brackets medians: ranks are off by one in so many at most.
SKETCH = 10_000


def medians(df: DataFrame, keys: list[str], value: Column, upper: str | None = None, true: str | None = None) -> DataFrame:
    """A4, A5: ``keys`` (one at least) and the upper median, the true one, or both; exact, null for groups without values.

    A first pass brackets the median by a sketch, which tells ranks to a known error; a second one counts what lies below, and
    the different values between the brackets, a few ten-thousandths of a group. So a group may be of any size.
    """
    rows = df.select(*keys, value.cast("double").alias("_v"))
    ends = F.percentile_approx("_v", [0.5 - 2 / SKETCH, 0.5 + 2 / SKETCH], SKETCH)
    groups = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), ends.alias("_e")).select(F.struct(*keys).alias("_k"), "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    near = rows.select(F.struct(*keys).alias("_key"), "_v").join(groups, F.col("_key").eqNullSafe(F.col("_k"))).where("_v <= _hi")
    # what is below counts as one value, null
    counted = near.groupBy("_k", "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_x")).agg(F.count("*").alias("_c"))
    placed = counted.withColumn("_to", F.sum("_c").over(Window.partitionBy("_k").orderBy(F.asc_nulls_first("_x"))))
    holds = lambda rank: F.max(F.when((F.col("_to") > rank) & (F.col("_to") - F.col("_c") <= rank), F.col("_x")))
    found = placed.groupBy(F.col("_k").alias("_key")).agg(holds(F.floor(F.col("_n") / 2)).alias("_a"), holds(F.floor((F.col("_n") - 1) / 2)).alias("_b"))
    both = {upper: F.col("_a"), true: (F.col("_a") + F.col("_b")) / 2}
    return groups.join(found, F.col("_k").eqNullSafe(F.col("_key")), "left").select("_k.*", *[c.alias(name) for name, c in both.items() if name])


def _with_medians(grouped: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    named = found.withColumnsRenamed({k: f"_m_{k}" for k in keys})
    return grouped.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]), "left").drop(*[f"_m_{k}" for k in keys])


def summary(results: DataFrame) -> DataFrame:
    """One row. Rates are over judged rows, citation accuracy over all, latency over rows that have one; 0.0 without any."""
    judged = F.col("relevant").isNotNull()
    one = results.agg(
        F.count("*").alias("total"),
        or_zero(rate(F.col("relevant"), judged)).alias("relevance_rate"),
        or_zero(rate(F.col("hallucination"), judged)).alias("hallucination_rate"),
        or_zero(rate(F.col("refusal"), judged)).alias("refusal_rate"),
        or_zero(mean(F.col("citation_score"))).alias("citation_accuracy"),
        or_zero(mean(F.col("latency_ms"))).alias("latency_ms_avg"),
        F.coalesce(F.sum(F.coalesce("judge_cost_usd", F.lit(0.0))), F.lit(0.0)).alias("judge_cost_usd"),
    )
    found = medians(results.withColumn("_all", F.lit(0)), ["_all"], F.col("latency_ms"), upper="_p50")
    out = _with_medians(one.withColumn("_all", F.lit(0)), found, ["_all"])
    return out.select("total", "relevance_rate", "hallucination_rate", "refusal_rate", "citation_accuracy", "latency_ms_avg", or_zero(F.col("_p50")).alias("latency_ms_p50"), "judge_cost_usd")


def by_group(results: DataFrame, key: Column, name: str) -> DataFrame:
    """The same measures for each value of an expression, in the order of its values."""
    judged = F.col("relevant").isNotNull()
    return (
        results.groupBy(key.alias(name))
        .agg(
            F.count("*").alias("count"),
            or_zero(rate(F.col("relevant"), judged)).alias("relevance_rate"),
            or_zero(rate(F.col("hallucination"), judged)).alias("hallucination_rate"),
            or_zero(rate(F.col("refusal"), judged)).alias("refusal_rate"),
            or_zero(mean(F.col("citation_score"))).alias("citation_accuracy"),
            or_zero(mean(F.col("latency_ms"))).alias("latency_ms_avg"),
        )
        .orderBy(name)
    )


def by_groupings(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """All rows, and the groups of each key, in one pass: ``grouping`` is the key's name, empty for all rows."""
    sets = [[], *([F.col(k)] for k in keys)]
    out = df.groupingSets(sets, *keys).agg(F.grouping_id().alias("_id"), *aggregates)
    full = (1 << len(keys)) - 1
    name = F.lit("")
    for i, k in enumerate(keys):
        name = F.when(F.col("_id") == full - (1 << (len(keys) - 1 - i)), k).otherwise(name)
    return out.withColumn("grouping", name).drop("_id")


def run_stats(rows: DataFrame, key: str = "run_label") -> DataFrame:
    """A10: statistics of each run for a comparison: zero latencies don't count, rates are null for a run without verdicts."""
    judged = F.col("relevant").isNotNull()
    found = medians(rows, [key], F.nullif(F.col("latency_ms"), F.lit(0.0)), true="latency_p50")
    grouped = rows.groupBy(key).agg(
        F.count("*").alias("count"),
        or_zero(mean(F.col("citation_score"))).alias("citation_accuracy"),
        or_zero(mean_truthy(F.col("latency_ms"))).alias("latency_avg"),
        or_zero(mean(F.coalesce(F.length("answer"), F.lit(0)))).alias("answer_len_avg"),
        rate(F.col("relevant"), judged).alias("relevance_rate"),
        rate(F.col("hallucination"), judged).alias("hallucination_rate"),
        rate(F.col("refusal"), judged).alias("refusal_rate"),
    )
    return _with_medians(grouped, found, [key]).withColumn("latency_p50", or_zero(F.col("latency_p50")))


def by_difficulty(rows: DataFrame, metric: str, key: str = "run_label", categories: tuple[str, ...] = DIFFICULTIES) -> DataFrame:
    """How often a metric is true (not zero) for each run and difficulty among rows that have it; all categories in
    their order as columns, 0 where none has a value."""
    value = F.when(F.col(metric).isNotNull(), (F.col(metric).cast("double") != 0).cast("double"))
    return rows.groupBy(key).agg(*[or_zero(F.avg(F.when(F.col("difficulty") == c, value))).alias(c) for c in categories])

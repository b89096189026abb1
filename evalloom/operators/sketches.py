"""Approximate figures that merge: sketches are stored by group, rolled up to coarser groups, and read with known errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sketch of distinct values has 2**LG registers.
LG = 12
#: What a sketch of quantiles keeps.
KEPT = 800
#: Count-min: rows of counters and counters of a row.
DEPTH, WIDTH = 5, 2048
#: Relative error of distinct counts, four standard errors of 2**LG registers: one estimate in some ten thousand is further off.
DISTINCT_ERROR = 4 * 1.04 / math.sqrt(1 << LG)
#: Error of a quantile's rank as a share of all values; with ``KEPT`` 99 of 100 quantiles are within half of it.
RANK_ERROR = 0.01


def summarised(df: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """``keys, n, distinct_sketch, value_sketch``: a row a group, each sketch of bounded size whatever the group's. Sketches are made
    before the shuffle, so a hot group is summed up where its rows are. Nulls count in ``n`` only; a group without values has a
    null sketch of them."""
    number = F.col(value).cast("double")
    values = F.when(F.count(number) > 0, F.kll_sketch_agg_double(F.coalesce(number, F.lit(None)), F.lit(KEPT)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, LG).alias("distinct_sketch"), values.alias("value_sketch"))


def rolled_up(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored summaries merged to coarser groups (no keys: one), without the rows they came from. As good as a direct summary."""
    values = F.when(F.count("value_sketch") > 0, F.kll_merge_agg_double("value_sketch", F.lit(KEPT)))
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), values.alias("value_sketch"))


def distinct_estimate(sketch: Column | str = "distinct_sketch") -> Column:
    """Distinct values of a group, within ``DISTINCT_ERROR`` of their number."""
    return F.hll_sketch_estimate(sketch)


def quantile_estimate(rank: float, sketch: Column | str = "value_sketch") -> Column:
    """A value whose rank among the group's values is within ``RANK_ERROR`` of ``rank``; null for a group without values."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))


def _slots(value: Column) -> Column:
    """The counter that a value has in each row."""
    return F.array(*[F.struct(F.lit(i).alias("line"), F.pmod(F.xxhash64(F.lit(i), value), F.lit(WIDTH)).cast("int").alias("slot")) for i in range(DEPTH)])


def count_min(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, line, slot, n``: a count-min sketch as rows, ``DEPTH`` times ``WIDTH`` a group at most. Null values aren't counted."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.inline(_slots(F.col(value))))
    return rows.groupBy(*keys, "line", "slot").agg(F.count("*").alias("n"))


def merged_counts(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Count-min sketches of coarser groups: counters add up, so they are equal to those of a direct sketch."""
    return stored.groupBy(*keys, "line", "slot").agg(F.sum("n").alias("n"))


def estimated_counts(stored: DataFrame, asked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``asked`` (``keys`` and ``value``, distinct) with ``estimate``: how often the value is in the group. Never below the truth; for
    a group of n values above it by more than 2 n / ``WIDTH`` in one of 2**``DEPTH`` cases at most. Values never seen may have 0."""
    wanted = asked.select(*keys, value, F.inline(_slots(F.col(value))))
    found = wanted.join(stored, [*keys, "line", "slot"], "left")
    return found.groupBy(*keys, value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))

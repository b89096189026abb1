"""Joins by order: the last row at or before a time (as-of), and points inside intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import written

#: Levels of interval lengths that a join keeps apart at most; lengths are powers of two of the least bin.
LEVELS = 64


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, values: list[str], tie: str, found: str = "found") -> DataFrame:
    """All rows of ``left`` and, in the struct ``found``, time and ``values`` of the last row of ``right`` with the same ``key`` at or
    before ``time``; null if there is none, or if key or time is null.

    Of right rows with one key and time the one with the greatest ``tie`` counts, which is settled before anything is sorted.
    Both sides are dealt into ranges of key, time and place, so a key that a third of all rows have goes through many tasks.
    Each range fills its rows from its own last right row; what stands before its first one gets the last right row of the
    ranges before, one row a range, which is broadcast. No join of the two tables takes place.
    """
    value = F.struct(F.col(right_time).alias(right_time), *values)
    once = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).groupBy(F.col(key).alias("k"), F.col(right_time).alias("t")).agg(F.max_by(value, F.col(tie)).alias("v"))
    rows = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    both = once.select("k", "t", F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "v")
    both = both.unionByName(rows.select("k", "t", F.lit(1).alias("side"), "row", F.lit(None).cast(once.schema["v"].dataType).alias("v")))
    # places are written before ranges are cut by them, so a repeated task deals its rows alike
    placed = written(both.withColumn("place", F.monotonically_increasing_id()), "asof")
    order = [F.asc_nulls_first("k"), F.asc_nulls_first("t"), F.asc("side"), F.asc("place")]
    ranges = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = written(ranges.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop("place"), "asof-ranges")
    ends = ranges.where("side = 0").groupBy("part").agg(F.max_by(F.struct("k", "v"), "at").alias("end"))
    # a range without right rows passes on what the one before it had
    parts = ranges.select("part").distinct().join(ends, "part", "left")
    carried = parts.select("part", F.last("end", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    own = F.last("v", True).over(Window.partitionBy("part", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    filled = ranges.withColumn("own", own).where("side = 1").join(F.broadcast(carried), "part")
    hit = F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), F.coalesce("own", F.when(F.col("carry.k") == F.col("k"), F.col("carry.v"))))
    return filled.select("row.*", hit.alias(found))


def least_bin(intervals: DataFrame, low: str, high: str, share: float = 0.5) -> float:
    """Width of the least bin: a quantile of the lengths, from a sketch. Shorter intervals share it."""
    r = intervals.select(F.percentile_approx(F.col(high) - F.col(low), share, 1000).alias("w")).first()
    return float(r["w"]) if r["w"] else 1.0


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, on: list[str] | None = None, width: float | None = None) -> DataFrame:
    """All columns of both sides for each point with ``low <= point <= high`` and equal ``on`` (which ``points`` gives); numbers only.

    An interval has a level, the power of two of the least bin's ``width`` that isn't shorter than it, and lies in two bins of
    that level at most; a point is in one bin of each level that occurs. So both sides meet in an equi-join, with the bounds as
    the rest of its condition, and each pair is there once, with no list of pairs to clean. Which levels there are is one small
    aggregate (``LEVELS`` at most). A bin that holds a third of all points is split by the adaptive join. Nulls and intervals that
    end before they begin match nothing.
    """
    on = on or []
    width = width or least_bin(intervals, low, high)
    size = (F.col(high) - F.col(low)).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(width)) / width))).cast("int")
    valid = intervals.where(F.col(high) >= F.col(low)).withColumn("_level", level)
    levels = sorted(r[0] for r in valid.select("_level").distinct().limit(LEVELS + 1).collect())
    if len(levels) > LEVELS:
        raise ValueError(f"lengths of intervals differ by more than 2^{LEVELS} times")
    bin_of = lambda c, n: F.floor(F.col(c).cast("double") / (F.lit(width) * F.pow(F.lit(2.0), n)))
    # rounding may move a bound by a bin, so what an interval reaches is cut by both ends' own bins
    spread = valid.withColumn("_bin", F.explode(F.sequence(bin_of(low, F.col("_level")), bin_of(high, F.col("_level")))))
    held = points.where(F.col(point).isNotNull())
    held = held.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bin_of(point, F.col("_level")))
    spread = spread.withColumnsRenamed({c: f"_i_{c}" for c in on})
    given = (held["_level"] == spread["_level"]) & (held["_bin"] == spread["_bin"])
    for c in on:
        given = given & (held[c] == spread[f"_i_{c}"])
    inside = (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    return held.join(spread, given & inside).drop(held["_level"], held["_bin"], spread["_level"], spread["_bin"], *[f"_i_{c}" for c in on])


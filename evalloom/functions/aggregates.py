"""Aggregates with exact denominators and two medians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def rate(flag: Column, judged: Column | None = None) -> Column:
    """A1: share of true among judged rows (by default those with a flag); a null flag in a judged row is false. Null without any."""
    judged = flag.isNotNull() if judged is None else judged
    return F.avg(F.when(judged, F.coalesce(flag, F.lit(False)).cast("int").cast("double")))


def mean(c: Column) -> Column:
    """A2, A3: nulls skipped; null without values."""
    return F.avg(c.cast("double"))


def mean_truthy(c: Column) -> Column:
    """Nulls and zeros skipped."""
    return F.avg(F.nullif(c.cast("double"), F.lit(0.0)))


def upper_median(column: str) -> Column:
    """The element at half the count in ascending order; of an even count the upper one of the middle two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def true_median(c: Column) -> Column:
    """A5: of an even count the mean of the middle two."""
    return F.median(c)


def box(c: Column) -> list[Column]:
    """Quartiles by linear interpolation, ends and mean."""
    q = [F.percentile(c, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return [F.min(c).alias("lowest"), *q, F.max(c).alias("highest"), F.avg(c).alias("mean")]


#: The top of an axis without values; factor and surplus up to 100; factor, share and least surplus above.
HEADROOM = (15.0, 1.28, 10.0, 1.18, 0.05, 50.0)


def headroom(c: Column, percent: bool = False) -> Column:
    """The top of an axis over values, nulls skipped. Percentages, and axes that end at 100 or below, stop at 100."""
    none, near, plus, far, share, least = HEADROOM
    top = F.max(c.cast("double"))
    low = F.least(F.lit(100.0), top * near + plus)
    return F.when(top.isNull(), F.lit(none)).when(F.lit(percent) | (top <= 100), low).otherwise(top * far + F.greatest(top * share, F.lit(least)))

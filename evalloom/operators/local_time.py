"""Local days across changes of the clock, and sums over a moving interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_time(utc: Column | str, zone: Column | str) -> Column:
    """Wall-clock time in a zone (a column) of a UTC time without zone, whatever the session's zone is. Null stays null."""
    return F.convert_timezone(F.lit("UTC"), F.col(zone) if isinstance(zone, str) else zone, utc)


def local_days(df: DataFrame, utc: str, zone: str) -> DataFrame:
    """``df`` with ``local_day`` and ``day_hours``: how many hours that day has there (23 and 25 where the clock changes)."""
    day = F.to_date(local_time(utc, zone))
    midnight = lambda d: F.convert_timezone(F.col(zone), F.lit("UTC"), d.cast("timestamp_ntz"))
    hours = F.timestamp_diff("SECOND", midnight(day), midnight(F.date_add(day, 1))) / 3600
    return df.withColumns({"local_day": day, "day_hours": hours})


def moving_sum(df: DataFrame, key: str, at: str, value: str, seconds: int, name: str = "moving") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the key from ``seconds`` before a row up to its time, ties included.

    Time is cut into pieces of ``seconds``, and each row is sent to its own and the next piece, where it only adds to others. So
    a frame never reaches beyond a piece, and a hot key is spread over its pieces; no task sorts all rows of a key. Rows without a
    time have null and add nothing; rows without a key are one key. Sums are null where no row of the frame has a value.
    """
    span = seconds * 1_000_000
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(df.schema[at].dataType), F.col(at))
    piece = micros - F.pmod(micros, F.lit(span))
    timed = df.where(F.col(at).isNotNull())
    sent = timed.withColumn("_piece", F.explode(F.array(piece, piece + span))).withColumn("_own", F.col("_piece") == piece)
    frame = f"(PARTITION BY `{key}`, _piece ORDER BY `{at}` RANGE BETWEEN INTERVAL '{seconds}' SECOND PRECEDING AND CURRENT ROW)"
    found = sent.withColumn(name, F.expr(f"sum(`{value}`) OVER {frame}")).where("_own").drop("_piece", "_own")
    return found.unionByName(df.where(F.col(at).isNull()).withColumn(name, F.lit(None)))

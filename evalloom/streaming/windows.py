"""Windows of event time over a stream: late rows are told by a rule that doesn't hang on batches, and state ends with the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import folder

#: True in rows that only fill up a slice's files; files of others don't have the column.
FILLER = "_filler"


def late(time: str, arrival: str, minutes: int) -> Column:
    """Whether a row came more than ``minutes`` after its event. A row without a time is late: no window can hold it."""
    return F.coalesce(F.col(arrival) > F.col(time) + F.make_dt_interval(mins=F.lit(minutes)), F.lit(True))


def land(df: DataFrame, arrival: str, slices: int = 5) -> tuple[str, int]:
    """Write rows as they came, slice of time by slice, into a fresh shared folder; the folder and the files of a slice.

    Each slice is a folder of as many files, so a stream that takes so many files at a time takes one slice a batch. A slice with too
    few rows for so many gets files of one filler row, or a batch would take part of the next slice and leave its other rows behind.
    The rows are dealt into slices once; each is then moved by reading no other.
    """
    spark = df.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = df.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).withColumn("step", F.greatest((F.unix_micros("b") - F.unix_micros("a")) / slices, F.lit(1.0)))
    at = F.least(F.floor((F.unix_micros(arrival) - F.unix_micros("a")) / F.col("step")), F.lit(slices - 1))
    staged, landed = folder(spark, "staged"), folder(spark, "landed")
    df.crossJoin(F.broadcast(ends)).withColumn("_slice", F.coalesce(at, F.lit(0)).cast("int")).drop("a", "b", "step").write.partitionBy("_slice").parquet(staged)
    kept = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(staged)
    for i in range(slices):
        kept.where(F.col("_slice") == i).drop("_slice").repartition(files).write.parquet(f"{landed}/{i}")
        lacking = files - len(spark.read.schema(df.schema).parquet(f"{landed}/{i}").inputFiles())
        if lacking > 0:  # a file for each partition of one row
            spark.range(0, lacking, 1, lacking).select(F.lit(True).alias(FILLER)).write.mode("append").parquet(f"{landed}/{i}")
    return landed, files


def landed_stream(spark, path: str, files: int, schema) -> DataFrame:
    """The files of ``land`` as a stream, a slice a batch, oldest first."""
    with_filler = T.StructType([*schema.fields, T.StructField(FILLER, T.BooleanType())])
    return spark.readStream.schema(with_filler).option("maxFilesPerTrigger", files).parquet(f"{path}/*").where(F.col(FILLER).isNull()).drop(FILLER)


def on_time(stream: DataFrame, time: str, arrival: str, minutes: int) -> DataFrame:
    """Rows that aren't late, under a watermark of the same delay.

    Whatever the batches are, as long as a batch has no row that came before the last batch's end, the watermark drops none of
    these rows: what came so far is no younger than now, and they are no older than ``minutes``. So results are those of the
    whole table.
    """
    return stream.where(~late(time, arrival, minutes)).withWatermark(time, f"{minutes} minutes")


def tumbling(rows: DataFrame, time: str, size: str, by: list[str], *aggs: Column) -> DataFrame:
    """A row for each window and key that has rows; a hot key is added up before the shuffle."""
    return rows.groupBy(F.window(time, size).alias("window"), *by).agg(*aggs)


def sliding(rows: DataFrame, time: str, size: str, step: str, by: list[str], *aggs: Column) -> DataFrame:
    """As ``tumbling``, each row in ``size / step`` windows."""
    return rows.groupBy(F.window(time, size, step).alias("window"), *by).agg(*aggs)


def sessions(rows: DataFrame, time: str, gap: str, by: list[str], *aggs: Column) -> DataFrame:
    """Rows of a key between which there is no ``gap``; a session ends a gap after its last row."""
    return rows.groupBy(F.session_window(time, gap).alias("window"), *by).agg(*aggs)


def to_table(stream: DataFrame, name: str, checkpoint: str | None = None, table: str | None = None):
    """Run a stream over what there is, in append mode, into a Parquet table in the shared folder; ``(rows, query)``.

    The table's own log names what belongs to it, so a batch that is written twice is there once. Only windows that the
    watermark has closed are in the result; open ones stay in the state of ``checkpoint``, which the next run goes on from.
    """
    spark = stream.sparkSession
    table = table or folder(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint or folder(spark, f"{name}-state")).option("path", table).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table), query

"""A resumable runner as a stream: each micro-batch asks only what the log lacks and appends the answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.runs import pending
from ..sources.readers import answered_ids
from ..sources.workspace import folder


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], log: str, checkpoint: str):
    """Start the query and return it. Ids that the log has are skipped, repeated ids are asked once. A failed call counts as
    answered (its record says why).

    The log is read once after a start, and its ids are kept as a table; ids that come again later are known to the query's
    state. A batch that fails ends the query, so what it wrote is in the log that the next start reads.
    """
    known = []

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if not known:
            path = folder(spark, "answered")
            answered_ids(spark, log).write.parquet(path)
            known.append(path)
        answer(pending(batch, spark.read.parquet(known[0]))).write.mode("append").json(log)

    return questions.dropDuplicates(["id"]).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

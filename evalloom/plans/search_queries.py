"""Registered queries of searches. Keys of those with SQL are those of ``search_sql.ORACLE``."""

from __future__ import annotations

from ..operators import search, vectors


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_search(spark, sf):
    """The ten best documents for each benchmark item, over all whole texts."""
    questions = _t(spark, sf, "benchmark")
    index = search.build_index(_t(spark, sf, "documents"), "doc_id", "text", questions.select("text"))
    return search.best(index, questions, "item_id", "text").withColumnRenamed("doc", "doc_id")


def vector_search(spark, sf):
    """The ten nearest vectors to each of those whose id is divisible by 50, among all. Not exact, so it has no SQL: recall is tested."""
    rows = _t(spark, sf, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding")


QUERIES = {f.__name__: f for f in (text_search, vector_search)}

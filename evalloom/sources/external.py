"""Hooks to what lies outside: models, endpoints and PDF parsers (S10, S12, S15, S16, U2-U5). Nothing here opens a connection."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.verdicts import parse_grade, parse_verdict


def with_stored(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The offline default: what an outside call would return is looked up in a table, null where it lacks."""
    return df.join(stored, keys, "left")


def call(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, calls: int | None = None) -> DataFrame:
    """Send rows in batches to ``fn``, which returns as many rows of ``schema``; ``calls`` bounds how many run at a time."""

    def run(batches):
        for rows in batches:
            if len(rows):
                yield fn(rows)

    return (df.repartition(calls) if calls else df).mapInPandas(run, schema)


def judged(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Verdict columns from a judge's raw replies."""
    return rows.withColumn("_v", parse_verdict(F.col(raw))).select("*", "_v.*").drop("_v")


def graded(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Grade and reasoning from raw replies of the judge of citations."""
    return rows.withColumn("_v", parse_grade(F.col(raw))).select("*", "_v.*").drop("_v")


def pdf_pages(spark, folder: str, extract: Callable[[bytes], list[str]], names: str = "*.pdf") -> DataFrame:
    """A page table from PDF files, by an injected parser ``bytes -> texts of the pages``; an unreadable file has one row
    without page and text, one that has no pages a row with page 0."""

    def run(batches):
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"]):
                try:
                    out += [(path, i, t) for i, t in enumerate(extract(content), 1)] or [(path, 0, None)]
                except Exception:
                    out.append((path, None, None))
            frame = pd.DataFrame(out, columns=["file", "page", "text"])
            yield frame.astype({"page": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    return files.select("path", "content").mapInPandas(run, schemas.CORPUS_PAGES)

"""Readers of question sets, answer logs, reports, manifests and files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import base_name, strip, suffix
from ..operators.relational import last_wins


#: Broken JSON stops a query; nothing is taken for an empty record.
_STRICT = {"mode": "FAILFAST"}


def _array(spark: SparkSession, path: str, element: str, wrappers: tuple[str, ...]) -> DataFrame:
    """Elements of a JSON file that is an array, or an object with the array under one of ``wrappers``; ``pos`` is their place.

    Text that is no such JSON stops the query, as does an object without any of the wrappers.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    wrapped = ", ".join(f"`{w}`: array<struct<{_colons(element)}>>" for w in wrappers)
    bare = F.from_json("value", f"array<struct<{_colons(element)}>>", _STRICT)
    held = F.from_json("value", f"struct<{wrapped}>", _STRICT)
    none = F.raise_error(F.lit(f"{path}: neither an array nor an object with {' or '.join(wrappers)}"))
    body = F.when(F.regexp_replace("value", r"^[\s﻿]+", "").startswith("["), bare).otherwise(F.coalesce(*[held[w] for w in wrappers], none.cast(f"array<struct<{_colons(element)}>>")))
    return raw.select(F.posexplode(body).alias("pos", "r")).select("r.*", "pos")


def _colons(schema: str) -> str:
    """``a int, b string`` as fields of a struct type."""
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """An array of questions, bare or under ``questions``. Of equal ids the last one's values at the first one's place."""
    return last_wins(_array(spark, path, schemas.QUESTIONS, ("questions",)), "id", "pos")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """An array of examples, bare or under ``examples`` or ``few_shot``."""
    return _array(spark, path, schemas.EXAMPLES, ("examples", "few_shot"))


def read_answers(spark: SparkSession, path: str, run_label: str | None = None) -> DataFrame:
    """S3, F1: a JSONL file of answers; blank lines are skipped, of equal ids the last one counts, at the first one's place."""
    out = last_wins(read_records(spark, path), "id", "pos")
    return out if run_label is None else out.withColumn("run_label", F.lit(run_label))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of a JSONL file of answers with their places, repeated ids included.

    Lines end at a line feed only. One file is one row until it is split, so the order of lines is kept; the answers of a run
    are as many as its questions. A line that is no JSON object, or has no id, stops the query.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    lines = lines.where(strip(F.col("line")) != "")
    told = F.concat(F.lit(f"{path}: no id in line "), (F.col("pos") + 1).cast("string"))
    parsed = lines.select("pos", F.from_json("line", schemas.ANSWERS, _STRICT).alias("r")).select("r.*", "pos")
    return parsed.withColumn("id", F.coalesce("id", F.raise_error(told).cast("string")))


def read_ordered_log(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_records`` for logs of any size, in any number of files: files are cut into splits that many tasks read.

    ``place`` is a struct of file, first byte of the split, and line, in the order of the lines: a split is read from its first
    line to its last by one task, and splits of a file follow each other. So ``last_wins(log, "id", "place")`` is what
    ``read_answers`` gives, with nothing read in one piece. Lines end at a line feed only, wherever a split is cut.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = raw.withColumn("place", F.struct("file", "start", F.monotonically_increasing_id().alias("line"))).where(strip(F.col("value")) != "")
    told = F.concat(F.lit("no id in "), F.col("place.file"), F.lit(": "), F.col("value"))
    parsed = lines.select("place", F.from_json("value", schemas.ANSWERS, _STRICT).alias("r"), told.alias("told")).select("r.*", "place", "told")
    return parsed.withColumn("id", F.coalesce("id", F.raise_error(F.col("told")).cast("string"))).drop("told")


def read_answer_log(spark: SparkSession, path: str) -> DataFrame:
    """Answers of any size in split files, without the order of lines: the form for large logs. Broken lines stop the query."""
    return spark.read.schema(schemas.ANSWERS).json(path, mode="FAILFAST")


def answered_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids that a log already has; none if there is no log yet."""
    try:
        return spark.read.schema("id string").json(path).where("id IS NOT NULL").distinct()
    except Exception as e:  # only a missing path is no log
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "id string")


def read_report(spark: SparkSession, path: str | None) -> DataFrame:
    """``results`` of a report by id; no path, no file or no results give no rows."""
    empty = spark.createDataFrame([], schemas.RESULTS)
    if path is None:
        return empty
    try:
        raw = spark.read.schema(schemas.REPORT).json(path, multiLine=True, mode="FAILFAST")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    rows = raw.select(F.posexplode("results").alias("pos", "r")).select("r.*", "pos")
    return last_wins(rows, "id", "pos").drop("pos")


def read_report_parts(spark: SparkSession, path: str) -> DataFrame:
    """``results`` of a report that ``sinks.write_report`` wrote, from its lines: no part of it has to fit one task."""
    line = F.regexp_replace("value", "^,", "")
    rows = spark.read.option("lineSep", "\n").text(path).where("NOT endswith(value, '[') AND value <> ']}'")
    return rows.select(F.from_json(line, schemas.RESULTS, _STRICT).alias("r")).select("r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An object of path -> URL as rows ``rel, url``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, string>", _STRICT)).alias("rel", "url"))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size`` of all files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))


def read_texts(spark: SparkSession, folder: str, errors: str = "replace") -> DataFrame:
    """``path, text`` of text files; undecodable bytes are replaced (``replace``) or dropped (``ignore``).

    U+FFFD that a file has itself stays: before the dropping it is written with another character, which is escaped too.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(".txt"))
    text = F.col("content").cast("string")
    if errors == "replace":
        return raw.select("path", F.make_valid_utf8(text).alias("text"))
    bad, mark = "�", "﷐"
    held = text
    for a, b in ((mark, mark + "1"), (bad, mark + "2")):
        held = F.replace(held, F.lit(a), F.lit(b))
    held = F.make_valid_utf8(held)
    for a, b in ((bad, ""), (mark + "2", bad), (mark + "1", mark)):
        held = F.replace(held, F.lit(a), F.lit(b))
    return raw.select("path", held.alias("text"))


def page_counts(pages: DataFrame) -> DataFrame:
    """``file, pages`` from a page table; a file that can't be read, or has no pages, has 0."""
    return pages.groupBy("file").agg(F.coalesce(F.max("page"), F.lit(0)).alias("pages"))


def preset_of_log(records: DataFrame) -> DataFrame:
    """One row at most, the preset that the first of ``read_records`` tells: its own, else ``default`` with examples, else ``baseline``."""
    told = F.when(F.coalesce("preset", F.lit("")) != "", F.col("preset")).when(F.coalesce("few_shot_examples", F.lit(0)) != 0, "default").otherwise("baseline")
    return records.orderBy("pos").limit(1).select(told.alias("preset"))


def labelled(raw: str) -> tuple[str, str]:
    """``Label|path``; without a bar the label is the file's stem."""
    label, bar, path = raw.partition("|")
    return (label.strip(), path) if bar else (os.path.splitext(os.path.basename(raw))[0], raw)


def label_columns(spec: Column) -> tuple[Column, Column]:
    """S18, C21, for a column: label and path."""
    at = F.instr(spec, "|")
    name = base_name(spec)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix(spec)))
    label = F.when(at > 0, strip(F.substring(spec, F.lit(1), at - 1))).otherwise(stem)
    return label, F.when(at > 0, F.substring(spec, at + 1, F.length(spec))).otherwise(spec)

"""Profiles of corpus and question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import box, mean_truthy, or_zero, upper_median
from ..functions.text import base_name, chars, cited_kind, component, first_class, has_digit, kind, script_ratio
from ..sources.constants import DIFFICULTIES, DOMAIN_LABELS, lookup
from .citations import in_manifest, options
from .relational import by_frequency, contains_join, flagged, missing, sorted_distinct


def corpus_files(manifest: DataFrame, sizes: DataFrame | None = None, hosts: list[tuple[str, str]] = (), other: str = "other") -> DataFrame:
    """Path parts, kind, host class and size of each file of a manifest; ``sizes`` is ``rel, size``."""
    rel = F.col("rel")
    out = manifest.select("rel", component(rel, 1).alias("domain"), component(rel, 2).alias("subdir"), kind(rel).alias("kind"), "url", first_class(F.col("url"), list(hosts), other).alias("host"), base_name(rel).alias("name"))
    return out.join(sizes, "rel", "left") if sizes is not None else out.withColumn("size", F.lit(None).cast("bigint"))


def question_rows(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each question with lengths, numbers of groups and sources, kinds and pages of its sources, and whether its answer
    has a digit and its groups are covered by the manifest."""
    flat = F.coalesce(F.flatten(F.transform("ground_truth_sources", lambda g: g["any_of"])), F.array().cast("array<struct<file:string,page:int>>"))
    out = questions.withColumns(
        {
            "q_len": chars(F.col("question")),
            "a_len": chars(F.col("ground_truth_answer")),
            "num_groups": F.coalesce(F.size("ground_truth_sources"), F.lit(0)),
            "num_sources": F.size(flat),
            "has_number": has_digit(F.col("ground_truth_answer")),
            "source_kinds": F.transform(flat, lambda s: cited_kind(s["file"])),
            "null_pages": F.size(F.filter(flat, lambda s: s["page"].isNull())),
            "page_numbers": F.transform(F.filter(flat, lambda s: s["page"].isNotNull()), lambda s: s["page"]),
        }
    )
    return in_manifest(out, manifest)


def kinds_by_domain(files: DataFrame, labels: dict[str, str] = DOMAIN_LABELS) -> DataFrame:
    """PDF and text files of each domain, by the domain's label."""
    out = files.groupBy("domain").agg(F.count_if(F.col("kind") == "pdf").alias("pdf"), F.count_if(F.col("kind") == "txt").alias("txt"))
    return out.withColumn("label", lookup("domain", labels)).orderBy("label")


def cross_tab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of pairs, a column for each value, zeros filled in."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def keyword_counts(files: DataFrame, keywords: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """Files by what their names contain; a file counts for each keyword it has. Ties go by the first file, then needle."""
    return by_frequency(contains_join(files, name, keywords), "label", F.struct(pos, "needle_pos"))


def citation_mix(rows: DataFrame) -> DataFrame:
    """Options that are PDF or text files, and questions with more than one group, by difficulty in its own order."""
    count = lambda k: F.coalesce(F.sum(F.size(F.filter("source_kinds", lambda x: x == k))), F.lit(0)).cast("bigint")
    out = rows.groupBy("difficulty").agg(count("pdf").alias("pdf"), count("txt").alias("txt"), F.count_if(F.col("num_groups") > 1).alias("multi_group"))
    order = F.array_position(F.array(*[F.lit(d) for d in DIFFICULTIES]), F.col("difficulty"))
    return out.where(order > 0).orderBy(order)


def domain_gaps(files: DataFrame, questions: DataFrame) -> DataFrame:
    """Files of each domain and whether any question is about it."""
    return flagged(files.groupBy("domain").agg(F.count("*").alias("docs")), questions.select("domain"), "domain", "has_questions").orderBy("domain")


def uncovered_domains(files: DataFrame, questions: DataFrame) -> DataFrame:
    """J13, X2."""
    return sorted_distinct(missing(files, questions, "domain"), "domain")


def missing_files(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Cited files that the corpus lacks."""
    return sorted_distinct(missing(options(questions).select("file"), files.select(F.col("rel").alias("file")), "file"), "file")


def text_profile(texts: DataFrame, text: str = "text") -> DataFrame:
    """Number, upper median of length, and mean script ratio of texts; 0.0 without any."""
    rows = texts.select(chars(F.col(text)).alias("n"), script_ratio(F.col(text)).alias("r"))
    return rows.agg(F.count("*").alias("count"), upper_median("n").alias("length_p50"), or_zero(F.avg("r")).alias("hebrew_ratio_avg"))


def page_profile(pages: DataFrame) -> DataFrame:
    """Mean and upper median of positive page counts; the mean is 0.0 and the median null without any."""
    positive = F.when(F.col("pages") > 0, F.col("pages"))
    counted = pages.withColumn("_p", positive)
    return counted.agg(or_zero(mean_truthy(F.col("pages"))).alias("pages_avg"), upper_median("_p").alias("pages_p50"), F.count("_p").alias("readable"))


def length_boxes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A31."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), *box(F.col(value).cast("double")))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts in ``bins`` equal bins from ``low`` to ``high``; the top end belongs to the last one, values outside to none."""
    x = F.col(value).cast("double")
    at = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(x.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def totals(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Bytes and domains of the corpus, its largest domain, questions with a digit in the answer. One row."""
    f = files.groupBy("domain").agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).agg(F.sum("docs").alias("files"), F.sum("bytes").alias("bytes"), F.count("*").alias("domains"), F.max("docs").alias("docs_max"))
    q = rows.agg(F.count("*").alias("questions"), F.count_if("has_number").alias("with_number"))
    return f.join(q)


def quantified(df: DataFrame, outer: str, inner: str, flag: Column) -> DataFrame:
    """For each outer key whether in all its inner groups any row has the flag. Dealt by the outer key once, for both aggregates."""
    return df.select(outer, inner, flag.alias("_flag")).repartition(outer).groupBy(outer, inner).agg(F.bool_or("_flag").alias("any")).groupBy(outer).agg(F.bool_and("any").alias("all_any"))

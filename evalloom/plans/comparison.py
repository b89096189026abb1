"""Compare runs: statistics of each, rates by difficulty, and the questions with all runs side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import citations, compare, metrics
from ..operators.relational import union_all


@dataclass
class Comparison:
    rows: DataFrame
    stats: DataFrame
    payload: DataFrame


def compare_runs(spark, questions: DataFrame, runs: list[tuple[str, DataFrame, DataFrame | None]], pages: DataFrame) -> Comparison:
    """``runs`` are (label, answers, evaluation rows or None), in the order of the columns.

    A stored citation score is kept, one that lacks is computed without a judge. Statistics are over answered questions, the
    payload has all questions.
    """
    labels = spark.createDataFrame([(label, i) for i, (label, *_) in enumerate(runs)], "run_label string, run_pos int")
    answers = union_all([a.withColumn("run_label", F.lit(label)) for label, a, _ in runs])
    empty = spark.createDataFrame([], "run_label string, id string, relevant boolean, hallucination boolean, refusal boolean, judge_reasoning string, citation_score double")
    stored = union_all([empty, *(e.select(F.lit(label).alias("run_label"), "id", "relevant", "hallucination", "refusal", "judge_reasoning", "citation_score") for label, _, e in runs if e is not None)])
    scored = citations.score(answers.select("run_label", "id", "citations"), citations.resolve(citations.cited(answers), pages))
    both = stored.withColumnRenamed("citation_score", "_stored").join(scored.select("run_label", "id", "citation_score"), ["run_label", "id"], "full")
    verdicts = both.withColumn("citation_score", F.coalesce("_stored", "citation_score", F.lit(0.0))).drop("_stored")
    rows = compare.run_rows(questions.select("id", "pos", "domain", "difficulty", "question"), labels, answers, verdicts)
    answered = rows.join(answers.select("run_label", "id"), ["run_label", "id"], "left_semi")
    return Comparison(rows, metrics.run_stats(answered), compare.payload(rows))

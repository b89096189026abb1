"""Score a run: questions with answers, citations, verdicts, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.verdicts import overridden
from ..operators import citations, metrics
from ..operators.relational import first_rows, inner


@dataclass
class Report:
    """Results and what is summed up from them (P11); all DataFrames, nothing has run yet."""

    results: DataFrame
    summary: DataFrame
    by_difficulty: DataFrame
    by_domain: DataFrame


def score_run(questions: DataFrame, answers: DataFrame, pages: DataFrame, verdicts: DataFrame | None = None, citation_verdicts: DataFrame | None = None, limit: int | None = None) -> Report:
    """J1, L5, P1, P2, A1-A9.

    Only answered questions count; ``limit`` takes the first of them, before anything is looked up. Verdicts are stored ones,
    joined by id; what they call invented isn't relevant. Without verdicts all rates are 0. A row's cost is that of both judges.
    """
    asked = questions.select("id", "domain", "difficulty", "question", "ground_truth_answer", "pos")
    given = answers.select("id", "answer", "citations", "latency_ms")
    joined = first_rows(inner(asked, given), limit)
    scored = citations.score(joined, citations.resolve(citations.cited(joined), pages), citation_verdicts)
    if verdicts is None:
        null = lambda t: F.lit(None).cast(t)
        rows = scored.withColumns({"relevant": null("boolean"), "hallucination": null("boolean"), "refusal": null("boolean"), "judge_reasoning": null("string"), "_cost": F.lit(0.0)})
    else:
        v = verdicts.select("id", overridden(F.col("relevant"), F.col("hallucination")).alias("relevant"), "hallucination", "refusal", "judge_reasoning", F.coalesce("cost_usd", F.lit(0.0)).alias("_cost"))
        rows = scored.join(v, "id", "left").withColumn("_cost", F.coalesce("_cost", F.lit(0.0)))
    results = rows.withColumn("judge_cost_usd", F.col("_cost") + F.col("citation_cost_usd")).drop("_cost", "citation_cost_usd")
    return Report(results, metrics.summary(results), metrics.by_group(results, F.col("difficulty"), "difficulty"), metrics.by_group(results, F.col("domain"), "domain"))

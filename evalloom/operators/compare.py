"""Runs side by side: payload, outcomes, filters and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import difficulty_rank, outcome, primary_outcome, token_sum
from ..functions.text import contains_any_case
from .relational import for_each, where_given


def run_rows(questions: DataFrame, runs: DataFrame, answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row for each question and run; a question that a run didn't answer has ``(missing)``.

    ``runs`` is the short list of runs, ``run_label, run_pos``. Answers and verdicts join by run and id.
    """
    grid = for_each(questions, runs)
    a = answers.select("run_label", "id", "answer", "citations", "latency_ms", "tokens").withColumn("_has", F.lit(True))
    v = verdicts.select("run_label", "id", "relevant", "hallucination", "refusal", "judge_reasoning", *(["citation_score"] if "citation_score" in verdicts.columns else []))
    out = grid.join(a, ["run_label", "id"], "left").join(v, ["run_label", "id"], "left")
    out = out.withColumn("answer", F.when(F.col("_has").isNull(), "(missing)").otherwise(F.col("answer"))).drop("_has")
    if "citation_score" not in out.columns:
        out = out.withColumn("citation_score", F.lit(0.0))
    return out.withColumns({"answer_len": F.length("answer").cast("bigint"), "outcome": outcome(F.col("relevant"), F.col("hallucination"), F.col("refusal"))})


def payload(rows: DataFrame) -> DataFrame:
    """Questions with the array ``runs`` in the order of the runs; as many elements as runs are compared."""
    fields = ["run_pos", "run_label", "answer", "citations", "latency_ms", "tokens", "relevant", "hallucination", "refusal", "judge_reasoning", "citation_score", "outcome"]
    listed = F.array_sort(F.collect_list(F.struct("run_pos", F.struct(*fields).alias("r"))))
    return rows.groupBy("id", "pos", "domain", "difficulty", "question").agg(F.transform(listed, lambda x: x["r"]).alias("runs"))


def explore(questions: DataFrame, domain: str | None = None, difficulty: str | None = None, search: str | None = None, shown: str | None = None) -> DataFrame:
    """Questions by domain, difficulty, a part of their text or id in any case, and the first run's outcome."""
    out = where_given(questions, domain=domain, difficulty=difficulty)
    if search:
        out = out.where(contains_any_case(F.col("question"), search) | contains_any_case(F.col("id"), search))
    if shown and shown != "all":
        out = out.where(primary_outcome(F.col("runs")) == shown)
    return out


def sort_key(name: str) -> Column:
    """What a column of the table is sorted by; always the first run's, missing values as 0. Unknown names sort by id."""
    r = F.try_element_at(F.col("runs"), F.lit(1))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    keys = {
        "id": F.col("id"),
        "domain": F.col("domain"),
        "difficulty": difficulty_rank(F.col("difficulty")),
        "outcome": primary_outcome(F.col("runs")),
        "relevant": flag(r["relevant"]),
        "hallucination": flag(r["hallucination"]),
        "refusal": flag(r["refusal"]),
        "citation": F.coalesce(r["citation_score"], F.lit(0.0)),
        "latency": F.coalesce(r["latency_ms"], F.lit(0.0)),
        "tokens": token_sum(r["tokens"]),
    }
    return keys.get(name, F.col("id"))


def arrange(questions: DataFrame, key: str = "id", ascending: bool = True) -> DataFrame:
    """Sorted by a key, equal ones by place."""
    c = sort_key(key)
    return questions.orderBy(c.asc() if ascending else c.desc(), "pos")


def agreement(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Q21: for two runs of the same questions, how many both judged and in how many each verdict is the same."""
    left = a.select("id", *[F.col(c).alias(f"_a_{c}") for c in columns])
    both = left.join(b.select("id", *[F.col(c).alias(f"_b_{c}") for c in columns]), "id")
    both = both.where(" AND ".join(f"_a_{c} IS NOT NULL AND _b_{c} IS NOT NULL" for c in columns))
    return both.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"_a_{c}") == F.col(f"_b_{c}")).alias(f"same_{c}") for c in columns])

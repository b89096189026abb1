"""Writers (K1-K5, K7)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.runs import pending


def write_jsonl(df: DataFrame, path: str, order: str = "pos") -> None:
    """K1: one JSONL file in the order of ``order``, written anew. For runs of a size that one file should hold."""
    df.repartition(1).sortWithinPartitions(order).drop(order).write.mode("overwrite").json(path)


def append_answers(spark, questions: DataFrame, done: DataFrame, answer, path: str) -> None:
    """K2: answers to the questions that the log lacks are appended to it; ``answer`` maps a DataFrame of questions to answers."""
    answer(pending(questions, done)).write.mode("append").json(path)


def report_json(summary: DataFrame, results: DataFrame | None = None, by: dict[str, DataFrame] | None = None, run_label: str = "") -> str:
    """A report as indented JSON, with group tables as maps and all results. For one run's report."""
    out = {"run_label": run_label} | summary.first().asDict(True)
    for name, frame in (by or {}).items():
        key, *rest = frame.columns
        out[f"by_{name}"] = {r[key]: {c: r[c] for c in rest} for r in frame.collect()}
    if results is not None:
        out["results"] = [r.asDict(True) for r in results.collect()]
    return json.dumps(out, ensure_ascii=False, indent=2)


def write_report(path: str, summary: DataFrame, results: DataFrame, by: dict[str, DataFrame] | None = None, run_label: str = "", order: str = "pos") -> None:
    """The same report as a folder of text files: one after the other, in the order of their names, they are its JSON.

    Only totals and groups go through the driver. Each result is a line, written by the task that has it, in the order of
    ``order`` (then of the line), which isn't written; nulls are.
    """
    spark = results.sparkSession
    head = json.loads(report_json(summary, None, by, run_label))
    begin, end = json.dumps(head, ensure_ascii=False)[:-1] + ', "results": [', "]}"
    lines = results.select(F.lit(1).alias("part"), F.struct(order, F.to_json(F.struct(*[c for c in results.columns if c != order]), {"ignoreNullFields": "false"}).alias("line")).alias("at"))
    first = lines.agg(F.min("at").alias("first"))
    lines = lines.crossJoin(F.broadcast(first)).select("part", "at", F.concat(F.when(F.col("at") == F.col("first"), "").otherwise(","), F.col("at.line")).alias("value"))
    ends = spark.createDataFrame([(0, begin), (2, end)], "part int, value string").select("part", F.lit(None).cast(lines.schema["at"].dataType).alias("at"), "value")
    whole = lines.unionByName(ends)
    whole.repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("value").write.option("lineSep", "\n").text(path)


def summary_text(summary: DataFrame, by_difficulty: DataFrame, run_label: str) -> str:
    """Rates in percent with one decimal, a line for each difficulty. Rounding happens here and nowhere before."""
    s = summary.first()
    lines = [f"Run: {run_label}", f"Questions: {s['total']}"]
    lines += [f"{name}: {s[c] * 100:.1f}%" for name, c in (("Relevance", "relevance_rate"), ("Hallucination", "hallucination_rate"), ("Refusal", "refusal_rate"), ("Citation accuracy", "citation_accuracy"))]
    lines += [f"Latency: mean {s['latency_ms_avg']:.0f} ms, median {s['latency_ms_p50']:.0f} ms", f"Judge cost: ${s['judge_cost_usd']:.4f}"]
    for r in by_difficulty.collect():
        lines.append(f"{r['difficulty']} ({r['count']}): relevance {r['relevance_rate'] * 100:.0f}%, hallucination {r['hallucination_rate'] * 100:.0f}%, citation {r['citation_accuracy'] * 100:.0f}%")
    return "\n".join(lines)


def payload_json(payload: DataFrame) -> DataFrame:
    """Each question with its runs as one JSON text."""
    return payload.select("id", F.to_json(F.struct(*payload.columns)).alias("json"))


def prompt_preview(messages: Column) -> Column:
    """K7: messages as readable text, each under its number and role."""
    rule = F.lit("=" * 60)
    part = F.transform(messages, lambda m, i: F.concat(rule, F.lit("\n["), i.cast("string"), F.lit("] "), F.upper(m["role"]), F.lit("\n"), rule, F.lit("\n"), m["content"], F.lit("\n")))
    return F.array_join(part, "\n")

"""Registered queries of specs, filters, reports, logs and judges' prompts on the driver's tables. Keys are those of ``table_sql.ORACLE``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations, compare, relational, runs
from ..sources import external, readers, sinks
from ..sources.constants import PRESETS
from ..sources.workspace import folder
from .evaluation import score_run
from .scoring_queries import JUDGE, _answers, _grades, _judged, _md5, _pages, _questions, _t


def run_specs(spark, sf):
    """Pages as specs of runs, with their models and endpoints."""
    k = F.col("page_id")
    spec = F.when(k % 3 == 0, F.concat(F.lit(" Few Shot "), k, F.lit(" |"), F.col("url"))).when(k % 3 == 1, F.concat(F.lit("runs/no-cite-"), k, F.lit(".eval.json"))).otherwise(F.concat(F.lit("a|"), k, F.lit("|c")))
    label, path = readers.label_columns(spec)
    model = F.concat(F.when(k % 2 == 0, "").otherwise("prov/"), F.lit("m"), k)
    base = F.concat(F.lit("http://h"), k, F.element_at(F.array(F.lit(""), F.lit("/"), F.lit("//")), (k % 3 + 1).cast("int")))
    rows = _t(spark, sf, "pages").select("page_id", label.alias("label"), path.alias("path"), runs.model_column(model, "prov").alias("model"), runs.endpoint_column(base, "/ask").alias("endpoint"))
    none = F.lit(None).cast("string")
    rows = rows.withColumn("preset", X.resolve_preset(none, none, F.col("label")))
    return rows.withColumns(runs.spec_columns(F.col("preset"), {p: f"{p}.md" for p in PRESETS}, {"default": "e.json"}, {"default": 10}))


def files_of_kind(spark, sf):
    """files of one kind, given by its name."""
    k = F.col("page_id")
    name = F.concat(k, F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".Txt").otherwise(".html"))
    files = _t(spark, sf, "pages").select("page_id", "url", X.kind(name).alias("kind"))
    return relational.where_given(files, kind="txt", url=None)


def explorer_by_domain(spark, sf):
    """questions of a domain and a difficulty that hold a text."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("domain"), F.element_at(F.array(*map(F.lit, ["easy", "medium", "hard"])), (F.col("doc_id") % 3 + 1).cast("int")).alias("difficulty"), F.col("text").alias("question"))
    found = [compare.explore(docs, domain=d, difficulty="medium", search=s) for d, s in (("src1", "EN"), ("", "1"))]
    return relational.union_all([f.withColumn("n", F.lit(i)) for i, f in enumerate(found)]).select("n", "id", "domain", "difficulty")


def report_parts(spark, sf):
    """A report written by many tasks and read again line by line."""
    report = score_run(_questions(spark, sf), _answers(spark, sf), _pages(spark, sf), _judged(spark, sf), _grades(spark, sf))
    path = folder(spark, "report-parts")
    sinks.write_report(path, report.summary, report.results.drop("citations", "citation_details", "tokens"), {"difficulty": report.by_difficulty, "domain": report.by_domain}, "run")
    out = readers.read_report_parts(spark, path)
    return out.select("id", "domain", "difficulty", "answer", "latency_ms", "citation_score", "citation_establishes", "relevant", "hallucination", "refusal", "judge_reasoning", "judge_cost_usd")


def ordered_log(spark, sf):
    """Events as a log in many files with blank lines, cut into small splits; the last record of each id counts."""
    path = folder(spark, "ordered-log")
    record = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("id"), F.concat("event_type", F.lit(" é "), "event_id").alias("answer"), F.col("value").alias("latency_ms")))
    lines = _t(spark, sf, "events").select("event_id", F.explode(F.when(F.col("event_id") % 50 == 0, F.array(F.lit(" \t"), record)).otherwise(F.array(record))).alias("value"))
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    out = relational.last_wins(readers.read_ordered_log(spark, path), "id", "place")
    return out.select("id", "answer", "latency_ms")


def citation_requests(spark, sf):
    """What the judge of citations is asked, for answers all of whose citations resolve."""
    a = _answers(spark, sf)
    out = citations.judge_requests(a, citations.resolve(citations.cited(a), _pages(spark, sf)), JUDGE, question=F.concat(F.lit("Q "), F.col("id")))
    return out.select("id", _md5("prompt").alias("md5"))


def citation_replies(spark, sf):
    """Replies of the judge of citations as grades."""
    k = F.col("event_id")
    said = F.element_at(F.array(*map(F.lit, [" Fully", "PARTIALLY\\n", "not_at_all", "perhaps"])), (k % 4 + 1).cast("int"))
    body = F.concat(F.lit('{"establishes": "'), said, F.lit('", "reasoning": "r'), k, F.lit('"}'))
    raw = F.when(k % 11 == 0, "no JSON").when(k % 7 == 0, '{"reasoning": 5}').when(k % 5 == 0, F.concat(F.lit("So: "), body, F.lit(" that's it"))).otherwise(body)
    return external.graded(_t(spark, sf, "events").select("event_id", raw.alias("raw"))).select("event_id", "establishes", "reasoning")


QUERIES = {f.__name__: f for f in (run_specs, files_of_kind, explorer_by_domain, report_parts, ordered_log, citation_requests, citation_replies)}

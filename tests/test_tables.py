"""Logs in splits, reports in parts, narrowed tables, and columns that are what the functions on single values are."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalloom.functions import verdicts as V
from evalloom.operators import citations, relational, runs
from evalloom.sources import readers, sinks


@pytest.mark.parametrize("size", [37, 1000, 1 << 20])
def test_a_log_in_splits_is_the_log_in_one_piece(spark, tmp_path, size):
    """Splits of any size cut lines and characters anywhere; blank lines and carriage returns stand at the cuts too."""
    lines = []
    for i in range(120):
        lines.append(json.dumps({"id": f"q{i * 7 % 50}", "answer": "é日本   " * (i % 5) + str(i)}, ensure_ascii=False))
        lines += ["", " \t", "\r"][: i % 4]
    path = f"{tmp_path}/log.jsonl"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(lines) + "\n" * (size % 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        log = readers.read_ordered_log(spark, f"file://{path}")
        if size < 1000:
            assert log.rdd.getNumPartitions() > 20
        got = [(r["id"], r["answer"]) for r in relational.last_wins(log, "id", "place").orderBy("place").collect()]
        every = [(r["id"], r["answer"]) for r in log.orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert every == [(r["id"], r["answer"]) for r in readers.read_records(spark, f"file://{path}").orderBy("pos").collect()]
    assert got == [(r["id"], r["answer"]) for r in readers.read_answers(spark, f"file://{path}").orderBy("pos").collect()]


@pytest.mark.parametrize("line", ["{broken", '{"answer": "no id"}'])
def test_broken_lines_of_a_log_stop_the_query(spark, tmp_path, line):
    with open(f"{tmp_path}/log", "w", encoding="utf-8") as f:
        f.write(f'{{"id": "a"}}\n{line}\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD|no id in"):
        readers.read_ordered_log(spark, f"file://{tmp_path}/log").collect()


@pytest.mark.parametrize("n", [0, 1, 25])
def test_a_report_in_parts_is_the_report(spark, tmp_path, n):
    rows = [(f"q{i}", f'say "é"\n[{i}', None if i % 2 else float(i), i) for i in range(n)]
    results = spark.createDataFrame(rows, "id string, answer string, latency_ms double, pos int").repartition(3)
    summary = spark.createDataFrame([(n, 0.5)], "total int, relevance_rate double")
    by = {"domain": spark.createDataFrame([("a", 1), ("b", 2)], "domain string, count int")}
    path = f"{tmp_path}/out"
    sinks.write_report(f"file://{path}", summary, results, by, "run", "pos")
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    whole = json.loads("".join(open(f"{path}/{p}", encoding="utf-8").read() for p in parts))
    want = json.loads(sinks.report_json(summary, results.orderBy("pos").drop("pos"), by, "run"))
    assert whole == want
    back = readers.read_report_parts(spark, f"file://{path}").select("id", "answer", "latency_ms").collect()
    assert sorted(map(tuple, back)) == sorted(r[:3] for r in rows)


@pytest.mark.parametrize("most", [0, 100_000])
def test_narrowed_keeps_exactly_the_keys(spark, monkeypatch, most):
    monkeypatch.setattr(relational, "BROADCAST_KEYS", most)
    df = spark.createDataFrame([(None if i % 11 == 0 else f"k{i % 400}", i, i) for i in range(3000)], "k string, v int, _slot int").repartition(3)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 900, 9)] + [(None,)], "other string")
    want = sorted((k, v) for k, v, _ in df.collect() if k is not None and int(k[1:]) % 9 == 0)
    got = relational.narrowed(df, "k", keys)
    assert got.columns == df.columns and sorted((r["k"], r["v"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and ("BroadcastHashJoin" in plan)
    assert relational.narrowed(df, "k", keys.where("false")).count() == 0


def test_only_cited_pages_are_kept(spark, monkeypatch):
    seen, write = [], citations.written
    monkeypatch.setattr(citations, "written", lambda df, name: seen.append(df) or write(df, name))
    pages = spark.createDataFrame([(f"d/{i}.txt", None, f"text {i}") for i in range(200)] + [("p.pdf", i, f"page {i}") for i in range(1, 8)], "file string, page int, text string")
    cites = spark.createDataFrame([("a", 0, "corpus/d/7.txt", None), ("a", 1, "p.pdf", 3), ("b", 0, "p.pdf", None), ("c", 0, "d/x.txt", 1), ("c", 1, " ", None)], "id string, cite_pos int, raw_file string, page int")
    out = {(r["id"], r["cite_pos"]): (r["ok"], r["error"], r["text"]) for r in citations.resolve(cites, pages).collect()}
    assert out["a", 0] == (True, None, "text 7") and out["a", 1] == (True, None, "page 3") and out["c", 0][1] == "file not found: d/x.txt" and out["c", 1][1] == "missing file path"
    assert out["b", 0][2].startswith("[page 1]\npage 1") and out["b", 0][2].endswith("[truncated: 7 pages total]")
    (kept,) = seen
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and kept.count() == 8
    assert plan.count("Exchange hashpartitioning") <= 1  # of the cited names; pages aren't dealt anew


def test_columns_are_the_functions_on_single_values(spark):
    specs = ["Few Shot|reports/a.jsonl", " Base |b.jsonl", "runs/no-cite.eval.json", "a|b|c", "noext", ".hidden", "x/.y.json", "|p", ""]
    models, bases = ["m", "prov/m", "prov", "other/m"], ["http://h", "http://h/", "http://h//"]
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    label, path = readers.label_columns(F.col("s"))
    assert {r["s"]: (r["label"], r["path"]) for r in df.select("s", label.alias("label"), path.alias("path")).collect()} == {s: readers.labelled(s) for s in specs}
    df = spark.createDataFrame([(m, b) for m in models for b in bases], "m string, b string")
    for r in df.select("m", "b", runs.model_column(F.col("m"), "prov").alias("x"), runs.endpoint_column(F.col("b"), "/ask").alias("y")).collect():
        assert (r["x"], r["y"]) == (runs.model_name(r["m"], "prov"), runs.endpoint(r["b"], "/ask"))
    prompts, examples, shots = {"default": "d.md", "concise": "c.md"}, {"default": "e.json"}, {"default": 10}
    want = {s["preset"]: (s["prompt"], s["examples_file"], s["message_count"]) for s in runs.prompt_specs(prompts, "r", examples, shots)} | {"odd": (None, None, 2)}
    df = spark.createDataFrame([("default",), ("concise",), ("odd",)], "p string").withColumns(runs.spec_columns(F.col("p"), prompts, examples, shots))
    assert {r["p"]: (r["prompt"], r["examples_file"], r["message_count"]) for r in df.collect()} == want


def test_replies_about_citations(spark):
    told = [('{"establishes": " FULLY ", "reasoning": "r"}', ("fully", "r")), ('x {"establishes": "some"} y', ("not_at_all", "")), ("[1]", None), (None, None), ("{}", ("not_at_all", ""))]
    out = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(told)], "i int, t string").select("i", V.parse_grade(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r["v"] and tuple(r["v"]) for r in out] == [w for _, w in told]

"""Operators on small rows: denominators, medians, nulls, ties and orders."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalloom import schemas
from evalloom.functions import aggregates as A
from evalloom.functions import conditions as C
from evalloom.functions import text as X
from evalloom.functions import verdicts as V
from evalloom.operators import citations, compare, metrics, profile, relational, runs
from evalloom.plans.comparison import compare_runs
from evalloom.plans.evaluation import score_run
from evalloom.plans.profiling import profile_corpus
from evalloom.sources import constants, external, readers, sinks
from evalloom.streaming.resume import answer_stream


def values(df, column):
    return [r[column] for r in df.collect()]


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("data", "upper", "true"), [([1, 2, 3, 10], 3.0, 2.5), ([1, 2, 9], 2.0, 2.0), ([5], 5.0, 5.0), ([], None, None)])
def test_two_medians(spark, data, upper, true):
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    assert tuple(df.agg(A.upper_median("x"), A.true_median(F.col("x"))).first()) == (upper, true)


@pytest.mark.parametrize("sketch", [10_000, 50])
def test_medians_of_groups(rows, monkeypatch, sketch):
    import statistics

    monkeypatch.setattr(metrics, "SKETCH", sketch)
    rng = random.Random(3)
    data = [(k, rng.choice([None, 1.0, float(rng.randint(0, 5)), rng.random()])) for k in (None, "a", "b", "c", "d") for _ in range({"a": 1, "b": 2, None: 7}.get(k, 3000))] + [("e", None)]
    got = {r["k"]: (r["upper"], r["true"]) for r in metrics.medians(rows(data, "k string, x double"), ["k"], F.col("x"), "upper", "true").collect()}
    want = {}
    for k in {k for k, _ in data}:
        v = sorted(x for g, x in data if g == k and x is not None)
        want[k] = (v[len(v) // 2], statistics.median(v)) if v else (None, None)
    assert got == want


def test_denominators(rows):
    df = rows([(True, True, 0.0, 1.0), (False, None, 10.0, 0.0), (None, None, None, 0.0)], "relevant boolean, hallucination boolean, latency_ms double, citation_score double")
    s = metrics.summary(df.withColumns({"refusal": F.lit(None).cast("boolean"), "judge_cost_usd": F.lit(0.5)})).first()
    assert (s["total"], s["relevance_rate"], s["hallucination_rate"], s["refusal_rate"]) == (3, 0.5, 0.5, 0.0)
    assert (s["citation_accuracy"], s["latency_ms_avg"], s["latency_ms_p50"], s["judge_cost_usd"]) == (1 / 3, 5.0, 10.0, 1.5)
    st = metrics.run_stats(df.withColumns({"refusal": F.lit(None).cast("boolean"), "run_label": F.lit("a"), "answer": F.lit("xy")})).first()
    assert (st["latency_avg"], st["latency_p50"], st["answer_len_avg"]) == (10.0, 10.0, 2.0)


def test_no_judged_rows(rows):
    df = rows([("e", None)], "difficulty string, relevant boolean").withColumns({c: F.lit(None).cast("boolean") for c in ("hallucination", "refusal")} | {c: F.lit(None).cast("double") for c in ("latency_ms", "citation_score", "judge_cost_usd")})
    g = metrics.by_group(df, F.col("difficulty"), "difficulty").first()
    assert (g["count"], g["relevance_rate"], g["latency_ms_avg"]) == (1, 0.0, 0.0)
    assert metrics.run_stats(df.withColumns({"run_label": F.lit("a"), "answer": F.lit(None).cast("string")})).first()["relevance_rate"] is None
    assert metrics.summary(df.where("false")).first()["total"] == 0


def test_groupings_name_their_key(rows):
    out = metrics.by_groupings(rows([("a", None), ("a", "x"), ("b", "x")], "k string, m string"), ["k", "m"], F.count("*").alias("n"))
    assert sorted((r["grouping"], r["k"] or "", r["m"] or "", r["n"]) for r in out.collect()) == [("", "", "", 3), ("k", "a", "", 2), ("k", "b", "", 1), ("m", "", "", 1), ("m", "", "x", 2)]


def test_last_wins_keeps_first_place(rows):
    df = rows([("a", 0, "x"), ("b", 1, "y"), ("a", 2, None)], "id string, pos int, v string")
    assert sorted((r["id"], r["pos"], r["v"]) for r in relational.last_wins(df, "id", "pos").collect()) == [("a", 0, None), ("b", 1, "y")]


def test_limits(rows):
    df = rows([(2,), (0,), (1,)], "pos int")
    assert values(relational.first_rows(df, 2), "pos") == [0, 1]
    assert relational.first_rows(df, 0).count() == relational.first_rows(df, None).count() == relational.first_rows(df, 9).count() == 3
    with pytest.raises(ValueError):
        relational.first_rows(df, -1)


@pytest.mark.parametrize(("path", "out"), [(" corpus/a\\b.aspx.txt ", "corpus/a/b.txt"[7:]), (" ../x", "../x"), ("", ""), ("corpus/corpus/a", "corpus/a"), ("A.PDF", "A.PDF")])
def test_paths(spark, path, out):
    assert one(spark, path, X.normalise_path) == out


def test_suffix_and_kind(spark):
    assert [one(spark, p, X.suffix) for p in ("a/b.PDF", ".pdf", "a.b/c", "x.tar.gz", "..a.b", "a.")] == [".pdf", "", "", ".gz", ".b", ""]
    assert [one(spark, p, X.kind) for p in ("a.PDF", "a.txt", "a")] == ["pdf", "txt", "other"]
    assert [one(spark, p, X.cited_kind) for p in ("a.PDF", "a.pdf")] == ["txt", "pdf"]
    assert [one(spark, "a/b", lambda c, n=n: X.component(c, n)) for n in (1, 2, 3)] == ["a", "b", ""]


def test_digits_of_any_script(spark):
    assert [one(spark, t, X.has_digit) for t in ("a3", "٣", "none", None)] == [True, True, False, None]
    assert one(spark, "אבx", X.script_ratio) == 0.5 and one(spark, "12", X.script_ratio) == 0.0


def test_presets(spark):
    assert [one(spark, t, X.preset_of_label) for t in ("Baseline run", "few-shot no cite", "Concise", "few shot", "x")] == ["baseline", "no-cite", "concise", "default", None]
    df = spark.createDataFrame([("", None, "x"), (None, "", "concise"), ("p", "q", "r")], "a string, b string, c string")
    assert values(df.select(X.resolve_preset(F.col("a"), F.col("b"), F.col("c")).alias("p")), "p") == ["baseline", "concise", "p"]


@pytest.mark.parametrize(
    ("raw", "out"),
    [
        ('{"relevant":"false"}', (True, False, False)), ('{"relevant":1,"refusal":0}', (True, False, False)), ("{}", (False, False, False)),
        ('```json\n{"relevant": true, "hallucination": true}\n```', (False, True, False)), ("none", None), ("", None), ("null", None), ("[1]", None), (None, None),
        ('{"relevant":null,"refusal":[],"hallucination":""}', (False, False, False)), ('{"relevant":[0],"refusal":{"a":1}}', (True, False, True)), ('{"relevant": 0.0}', (False, False, False)),
    ],
)
def test_verdicts(spark, raw, out):
    v = one(spark, raw, V.parse_verdict)
    assert (v if v is None else (v["relevant"], v["hallucination"], v["refusal"])) == out
    assert one(spark, raw, V.grade) == "not_at_all"


def test_grades_and_range(spark):
    assert [one(spark, t, V.grade) for t in (" Fully\n", "PARTIALLY", "x", None)] == ["fully", "partially", "not_at_all", "not_at_all"]
    assert [one(spark, x, V.in_range, "double") for x in (0.0, 1.0, 1.1, None)] == [True, True, False, True]


def test_outcomes(spark):
    df = spark.createDataFrame([(None, None, None), (True, True, True), (False, True, False), (True, False, False), (False, False, False)], "a boolean, b boolean, c boolean")
    out = C.outcome(F.col("a"), F.col("b"), F.col("c"))
    assert values(df.select(out.alias("o")), "o") == ["missing", "refusal", "hallucination", "relevant", "wrong"]
    assert values(df.select(C.card_class(out).alias("o")), "o") == ["", "", "fail", "ok", "fail"]
    assert [one(spark, x, lambda c: C.rate_class(c, True), "double") for x in (0.0, 0.5, None)] == ["bad", "good", None]
    assert [one(spark, x, lambda c: C.rate_class(c, False), "double") for x in (0.0, 0.3)] == ["good", "bad"]
    assert [one(spark, x, C.cell_class, "double") for x in (1.0, 0.9, None)] == ["yes", "no", "dash"]
    assert [one(spark, x, C.difficulty_rank) for x in ("easy", "hard", "x", None)] == [0, 2, -1, -1]
    assert one(spark, 7, lambda c: C.cycled(c, 3), "int") == 1 and one(spark, 0, lambda c: C.ratio(c, c), "int") == 0.0


PAGES = [("t.txt", None, "text"), ("e.txt", None, " \n"), *(("d.pdf", i, f"p{i}") for i in range(1, 8)), ("b.pdf", 1, " "), ("u.pdf", None, None), ("z.pdf", 0, None), ("x.doc", None, "?")]


def test_resolution_errors(spark, rows):
    cites = [("t.txt", 9), ("corpus/t.aspx.txt", None), ("", 1), (None, 1), ("no.pdf", 1), ("e.txt", None), ("u.pdf", 1), ("d.pdf", 0), ("d.pdf", 8), ("d.pdf", 3), ("d.pdf", None), ("b.pdf", 1), ("b.pdf", None), ("x.doc", None), ("z.pdf", 1), ("z.pdf", None)]
    answers = rows([("q", [(f, p, None) for f, p in cites])], "id string, citations array<struct<file:string,page:int,quote:string>>")
    out = sorted(citations.resolve(citations.cited(answers), spark.createDataFrame(PAGES, schemas.CORPUS_PAGES)).collect(), key=lambda r: r["cite_pos"])
    assert [r["error"] for r in out] == [
        None, None, "missing file path", "missing file path", "file not found: no.pdf", "empty text file", "unreadable PDF", "page 0 out of range (1-7)",
        "page 8 out of range (1-7)", None, None, "page 1 is empty", None, "unsupported file type: .doc", "PDF has no pages", "PDF has no pages",
    ]
    assert out[0]["text"] == out[1]["text"] == "text" and out[9]["text"] == "p3"
    assert out[10]["text"] == "\n\n".join(f"[page {i}]\np{i}" for i in range(1, 6)) + "\n\n[truncated: 7 pages total]"
    assert out[12]["ok"] and not out[11]["ok"]


def test_citation_scores(spark, rows):
    kind = "id string, citations array<struct<file:string,page:int,quote:string>>"
    answers = rows([("none", None), ("empty", []), ("bad", [("t.txt", None, None), ("no", 1, None)]), ("good", [("t.txt", None, None)]), ("odd", [("t.txt", None, None)]), ("skip", [("d.pdf", 2, None)])], kind)
    verdicts = spark.createDataFrame([("good", "Partially", "", 0.25), ("odd", "?", "", None), ("bad", "fully", "", 1.0)], "id string, establishes string, reasoning string, cost_usd double")
    s = {r["id"]: r for r in citations.score(answers, citations.resolve(citations.cited(answers), spark.createDataFrame(PAGES, schemas.CORPUS_PAGES)), verdicts).collect()}
    assert {k: (r["citation_score"], r["citation_establishes"], r["citation_resolved"], r["citation_total"], r["citation_invalid"], r["citation_cost_usd"]) for k, r in s.items()} == {
        "none": (0.0, "not_at_all", 0, 0, 0, 0.0), "empty": (0.0, "not_at_all", 0, 0, 0, 0.0), "bad": (0.0, "not_at_all", 1, 2, 1, 0.0),
        "good": (0.5, "partially", 1, 1, 0, 0.25), "odd": (0.0, "not_at_all", 1, 1, 0, 0.0), "skip": (0.0, None, 1, 1, 0, 0.0),
    }
    assert s["bad"]["citation_details"][:2] == ["resolved t.txt", "invalid no: file not found: no"] and s["skip"]["citation_details"][0] == "resolved d.pdf p.2"


def test_legacy_scores(rows):
    group = "array<struct<any_of:array<struct<file:string,page:int>>>>"
    g = lambda *o: (list(o),)
    df = rows(
        [(1, [g(("a", None)), g(("b", 2), ("c", 3))], [("a", 7), ("c", 3)]), (2, [g(("b", 2)), g(("a", None))], [("b", 3), ("a", None)]), (3, [], None), (4, [g(("a", 1))], None)],
        f"k int, ground_truth_sources {group}, citations array<struct<file:string,page:int>>",
    )
    out = {r["k"]: (r["legacy_score"], r["legacy_establishes"], r["legacy_resolved"], r["legacy_total"], r["legacy_invalid"]) for r in citations.legacy_score(df).collect()}
    assert out == {1: (1.0, "fully", 2, 2, 0), 2: (0.5, "partially", 1, 2, 1), 3: (1.0, "fully", 0, 0, 0), 4: (0.0, "not_at_all", 0, 1, 1)}
    told = {r["k"]: r["legacy_details"] for r in citations.legacy_score(df).collect()}
    assert told[1] == ["group 1: reference hit (a)", "group 2: reference hit (c)"] and told[2][0] == "group 1: reference miss (expected one of ['b'])" and told[3] == ["no reference sources listed"]


def test_manifest_coverage(spark, rows):
    q = rows([("a", [([("x.pdf", 1), ("y", None)],), ([("x.pdf", 2)],)]), ("b", [([("z", 1)],)]), ("c", [])], "id string, ground_truth_sources array<struct<any_of:array<struct<file:string,page:int>>>>")
    m = spark.createDataFrame([("x.pdf", "u")], schemas.MANIFEST)
    assert {r["id"]: r["in_manifest"] for r in citations.in_manifest(q, m).collect()} == {"a": True, "b": False, "c": True}


def test_sources_and_sinks(spark, tmp_path):
    q = [{"id": f"q{i}", "domain": "car", "difficulty": d, "question": "?", "ground_truth_answer": "3", "ground_truth_sources": [{"any_of": [{"file": "t.txt", "page": None}]}]} for i, d in enumerate(("easy", "hard", "medium"))]
    for name, data in (("bare", q), ("held", {"questions": q})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        assert [tuple(r) for r in readers.read_questions(spark, f"{tmp_path}/{name}.json").orderBy("pos").select("id", "pos").collect()] == [("q0", 0), ("q1", 1), ("q2", 2)]
    log = tmp_path / "log.jsonl"
    log.write_text('{"id":"q0","answer":"x y","latency_ms":5}\n\n  \n{"id":"q1","answer":null,"citations":[{"file":"t.txt","page":1}]}\n{"id":"q0","answer":"z"}\n')
    a = readers.read_answers(spark, str(log), "run")
    assert sorted((r["id"], r["answer"], r["pos"], r["latency_ms"]) for r in a.collect()) == [("q0", "z", 0, None), ("q1", None, 3, None)]
    assert sorted(values(readers.answered_ids(spark, str(log)), "id")) == ["q0", "q1"] and readers.answered_ids(spark, f"{tmp_path}/no").count() == 0
    assert values(readers.preset_of_log(readers.read_records(spark, str(log))), "preset") == ["baseline"]
    told = tmp_path / "told.jsonl"
    told.write_text('\n{"id":"q0","answer":"x","few_shot_examples":10}\n{"id":"q0","answer":"y","preset":"concise"}\n')
    assert values(readers.preset_of_log(readers.read_records(spark, str(told))), "preset") == ["default"]
    for name, broken in (("line", '{"id":"a"}\n{"id":'), ("id", '{"id":"a"}\n{"answer":"x"}'), ("null", '{"id":null}')):
        (tmp_path / f"{name}.bad").write_text(broken)
        with pytest.raises(Exception, match="no id in line|MALFORMED"):
            readers.read_answers(spark, f"{tmp_path}/{name}.bad").collect()
    for name, broken in (("q", "[{"), ("w", '{"other": []}'), ("t", "nothing")):
        (tmp_path / f"{name}.json").write_text(broken)
        with pytest.raises(Exception, match="neither an array|MALFORMED"):
            readers.read_questions(spark, f"{tmp_path}/{name}.json").collect()
    (tmp_path / "m.json").write_text(json.dumps({"car/a.PDF": "http://h/1", "life/b.txt": "http://h/2"}))
    files = profile.corpus_files(readers.read_manifest(spark, f"{tmp_path}/m.json"), hosts=[("h/1", "one")])
    assert sorted((r["domain"], r["subdir"], r["kind"], r["host"], r["name"]) for r in files.collect()) == [("car", "a.PDF", "pdf", "one", "a.PDF"), ("life", "b.txt", "txt", "other", "b.txt")]
    (tmp_path / "ex.json").write_text(json.dumps({"few_shot": [{"id": "e", "question": "Q", "answer": "A", "citations": [{"file": "f", "page": 2}, {"file": "g"}]}]}))
    ex = readers.read_examples(spark, f"{tmp_path}/ex.json")
    m = runs.build_messages(readers.read_questions(spark, f"{tmp_path}/bare.json"), ex, "S").orderBy("pos").first()["messages"]
    assert [x["role"] for x in m] == ["system", "user", "assistant", "user"] and m[2]["content"].split("\n")[0] == "A" and m[2]["content"].split("\n")[3].startswith("- f, ") and m[2]["content"].endswith("\n- g")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_bytes(b"a\xffb")
    assert values(readers.read_texts(spark, f"{tmp_path}/t"), "text") == ["a�b"] and values(readers.read_texts(spark, f"{tmp_path}/t", "ignore"), "text") == ["ab"]
    assert values(readers.file_sizes(spark, f"{tmp_path}/t"), "size") == [3]
    rng = random.Random(1)
    (tmp_path / "u").mkdir()
    blobs = [rng.randbytes(40) + "a\ufffdé\ufdd0\ufdd01".encode() + bytes(rng.choice([0xC3, 0xE2, 0x82, 0xF0, 0x9F, 0x98, 0x41, 0xEF, 0xBF, 0xBD]) for _ in range(30)) for _ in range(40)]
    for i, b in enumerate(blobs):
        (tmp_path / f"u/{i}.txt").write_bytes(b)
    for errors in ("replace", "ignore"):
        assert sorted(values(readers.read_texts(spark, f"{tmp_path}/u", errors), "text")) == sorted(b.decode(errors=errors) for b in blobs)
    assert readers.labelled(" A |x/y.json") == ("A", "x/y.json") and readers.labelled("x/y.json") == ("y", "x/y.json")
    sinks.write_jsonl(a.select("id", "pos"), f"{tmp_path}/out")
    assert values(spark.read.text(f"{tmp_path}/out"), "value") == ['{"id":"q0"}', '{"id":"q1"}']
    assert readers.read_report(spark, None).count() == readers.read_report(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"run_label": "r", "results": [{"id": "a", "relevant": False}, {"id": "a", "relevant": True}]}))
    assert values(readers.read_report(spark, f"{tmp_path}/r.json"), "relevant") == [True]


def _fixture(spark, rows):
    q = rows([(f"q{i}", ("car", "life")[i % 2], ("easy", "medium", "hard")[i % 3], f"What {i}?", "3", i) for i in range(6)], "id string, domain string, difficulty string, question string, ground_truth_answer string, pos int")
    q = q.withColumn("ground_truth_sources", F.from_json(F.lit('[{"any_of":[{"file":"t.txt","page":null},{"file":"gone.pdf","page":1}]}]'), "array<struct<any_of:array<struct<file:string,page:int>>>>"))
    a = rows([("q0", "a", [("t.txt", None, None)], 5.0), ("q1", None, None, None), ("q3", "c", [("no", 1, None)], 7.0), ("zz", "d", None, 1.0)], "id string, answer string, citations array<struct<file:string,page:int,quote:string>>, latency_ms double")
    v = rows([("q0", True, True, False, "", 0.1), ("q1", True, False, False, "", None)], "id string, relevant boolean, hallucination boolean, refusal boolean, judge_reasoning string, cost_usd double")
    return q, a.withColumn("tokens", F.lit(None).cast("struct<prompt:bigint,completion:bigint>")), v, spark.createDataFrame(PAGES, schemas.CORPUS_PAGES)


def test_score_run(spark, rows):
    q, a, v, pages = _fixture(spark, rows)
    cv = spark.createDataFrame([("q0", "fully", "", 0.2)], "id string, establishes string, reasoning string, cost_usd double")
    report = score_run(q, a, pages, v, cv)
    s = report.summary.first()
    assert (s["total"], s["relevance_rate"], s["hallucination_rate"], s["citation_accuracy"], s["latency_ms_avg"], s["latency_ms_p50"]) == (3, 0.5, 0.5, 1 / 3, 6.0, 7.0)
    assert s["judge_cost_usd"] == pytest.approx(0.3)
    assert score_run(q, a, pages, v, cv, limit=2).summary.first()["total"] == 2 and score_run(q, a, pages).summary.first()["relevance_rate"] == 0.0
    assert values(report.by_difficulty, "difficulty") == ["easy", "medium"] and values(report.by_domain, "domain") == ["car", "life"]
    text = sinks.summary_text(report.summary, report.by_difficulty, "r")
    assert "Relevance: 50.0%" in text
    out = json.loads(sinks.report_json(report.summary, report.results, {"domain": report.by_domain}, "r"))
    assert out["total"] == 3 and len(out["results"]) == 3 and set(out["by_domain"]) == {"car", "life"}


def test_compare_runs(spark, rows):
    q, a, v, pages = _fixture(spark, rows)
    stored = v.withColumn("citation_score", F.lit(0.75)).drop("cost_usd")
    c = compare_runs(spark, q, [("one", a, stored), ("two", a.where("id = 'q0'"), None)], pages)
    stats = {r["run_label"]: r for r in c.stats.collect()}
    assert stats["one"]["count"] == 3 and stats["one"]["citation_accuracy"] == 0.5 and stats["two"]["relevance_rate"] is None
    p = {r["id"]: r["runs"] for r in c.payload.collect()}
    assert len(p) == 6 and [x["run_label"] for x in p["q2"]] == ["one", "two"] and p["q2"][0]["answer"] == "(missing)" and p["q0"][0]["outcome"] == "hallucination" and p["q1"][1]["answer"] == "(missing)"
    found = compare.arrange(compare.explore(c.payload, search="WHAT", shown="missing"), "difficulty", ascending=False)
    assert values(found, "id") == ["q2", "q5", "q4", "q3"]
    assert compare.explore(c.payload, domain="car", difficulty="easy").count() == 1 and compare.explore(c.payload, search="Q1").count() == 1
    for key in ("id", "domain", "outcome", "relevant", "hallucination", "refusal", "citation", "latency", "tokens", "?"):
        assert compare.arrange(c.payload, key).count() == 6
    assert sinks.payload_json(c.payload).where("json IS NOT NULL").count() == 6
    assert tuple(compare.agreement(v, v.withColumn("relevant", ~F.col("relevant")), "relevant", "hallucination").first()) == (2, 0, 2)


def test_profile(spark, rows):
    q, _, _, _ = _fixture(spark, rows)
    manifest = rows([("car/t.txt", "u"), ("new/a.pdf", "u"), ("t.txt", "u")], schemas.MANIFEST)
    out = profile_corpus(spark, manifest, None, q, rows([("אb",), (None,)], "text string"), rows([("a", 0), ("b", 4), ("c", 6)], "file string, pages int"))
    assert values(out["missing_files"], "file") == ["gone.pdf"] and values(out["uncovered_domains"], "domain") == ["new", "t.txt"]
    assert all(values(out["questions"], "in_manifest")) and values(out["questions"], "num_sources") == [2] * 6
    assert tuple(out["pages"].first())[:2] == (5.0, 6.0) and out["totals"].first()["with_number"] == 6
    assert [tuple(r)[1:] for r in out["citation_mix"].collect()] == [(2, 2, 0)] * 3
    assert {r["domain"]: r["has_questions"] for r in out["domain_gaps"].collect()} == {"car": True, "new": False, "t.txt": False}
    assert out["keywords"].count() == 0 and out["texts"].first()["count"] == 2


def test_frequencies_tie_by_first(spark, rows):
    files = rows([("b a", 0), ("a", 1), ("b", 2), ("none", 3)], "name string, pos int")
    needles = spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "needle string, label string, needle_pos int")
    assert [(r["label"], r["n"]) for r in profile.keyword_counts(files, needles).collect()] == [("A", 2), ("B", 2)]


def test_histogram_ends(rows):
    out = profile.histogram(rows([(0.0,), (10.0,), (9.99,), (11.0,), (None,)], "x double"), "x", 5, 0.0, 10.0)
    assert sorted(map(tuple, out.collect())) == [(0, 1), (4, 2)]


def test_hooks(spark, tmp_path):
    q = spark.createDataFrame([("a",), ("b",)], "id string")
    out = external.call(q, lambda pdf: pdf.assign(raw='{"relevant": true}'), "id string, raw string")
    assert values(external.judged(out), "relevant") == [True, True]
    assert external.with_stored(q, spark.createDataFrame([("a", 1)], "id string, v int"), ["id"]).where("v IS NULL").count() == 1
    (tmp_path / "a.pdf").write_bytes(b"x|y")
    (tmp_path / "b.pdf").write_bytes(b"!")

    def parser(raw):
        if raw == b"!":
            raise ValueError
        return raw.decode().split("|")

    pages = external.pdf_pages(spark, str(tmp_path), parser)
    assert sorted((r["file"][-5:], r["page"], r["text"]) for r in pages.where("page IS NOT NULL").collect()) == [("a.pdf", 1, "x"), ("a.pdf", 2, "y")]
    assert sorted(values(readers.page_counts(pages), "pages")) == [0, 2]
    none = external.pdf_pages(spark, str(tmp_path), lambda raw: [])
    assert [(r["page"], r["text"]) for r in none.collect()] == [(0, None)] * 2 and values(readers.page_counts(none), "pages") == [0, 0]


def test_stream_asks_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = f"{tmp_path}/log"
    asked = []

    def answer(df):
        asked.extend(values(df, "id"))
        return df.select("id", F.lit("x").alias("answer"))

    for n, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps({"id": i}) for i in ids))
        s = spark.readStream.schema("id string").json(f"{tmp_path}/in")
        answer_stream(s, answer, log, f"{tmp_path}/ck").awaitTermination()
    assert sorted(asked) == ["a", "b", "c"] == sorted(values(readers.answered_ids(spark, log), "id"))
    done, all_ = readers.answered_ids(spark, log), spark.createDataFrame([("a",), ("d",)], "id string")
    assert values(runs.pending(all_, done), "id") == ["d"]
    sinks.append_answers(spark, all_, done, lambda df: df.withColumn("answer", F.lit("y")), log)
    assert readers.answered_ids(spark, log).count() == 4


def test_texts(spark):
    assert one(spark, "<a & 'b'>", X.escape_html) == "&lt;a &amp; &#x27;b&#x27;&gt;" and one(spark, "'<", lambda c: X.escape_html(c, False)) == "'&lt;"
    assert one(spark, "{y}", lambda c: X.fill("a {x} {y} {x}", x=c, y=F.lit("1"))) == "a {y} 1 {y}"
    assert [one(spark, t, X.shown_answer) for t in ("", None, "a")] == ["(empty answer)", "(empty answer)", "a"]
    r = spark.createDataFrame([([("f", 0, "t"), ("g", 2, "u")],)], "x array<struct<file:string,page:int,text:string>>").select(X.source_blocks(F.col("x"))).first()[0]
    assert r == "--- Citation 1: f ---\nt\n\n--- Citation 2: g (page 2) ---\nu"
    m = spark.createDataFrame([([("user", "hi")],)], "x array<struct<role:string,content:string>>").select(sinks.prompt_preview(F.col("x"))).first()[0]
    assert m == f"{'=' * 60}\n[0] USER\n{'=' * 60}\nhi\n"
    assert [one(spark, x, X.title) for x in ("long-term care", "it's 2nd o'neil", "ÉTÉ x9y", "")] == [x.title() for x in ("long-term care", "it's 2nd o'neil", "ÉTÉ x9y", "")]
    assert one(spark, "\x1c\x1f\u2003 a\u00a0b \x1d\x85", X.strip) == "a\u00a0b"
    assert runs.model_name("m", "p") == "p/m" == runs.model_name("p/m", "p") and runs.endpoint("http://x/", "/ask") == "http://x/ask"
    assert [round(one(spark, x, lambda c: A.headroom(c), "double"), 6) for x in (None, 50.0, 90.0, 1000.0)] == [15.0, 74.0, 100.0, 1230.0]
    assert one(spark, 1000000, lambda c: C.token_cost(c, c), "bigint") == 2.5
    assert one(spark, "car", lambda c: constants.lookup(c, constants.DOMAIN_LABELS)) == "Car" and one(spark, "x", lambda c: constants.lookup(c, constants.DOMAIN_LABELS)) == "x"

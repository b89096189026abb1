"""Registered queries of readers, writers, citations, scoring and prompts. Keys are those of ``scoring_sql.ORACLE``.

The tables stand for what a run has: customers are answers, conversations and documents the corpus, benchmark items the
questions of files (which one file holds, whatever the scale of the other tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conditions as C
from ..functions import text as X
from ..functions import verdicts as V
from ..operators import citations, compare, metrics, profile, relational, runs
from ..sources import external, readers, sinks
from ..sources.constants import DOMAIN_LABELS, ESTABLISHES, KEYWORDS, PAGE_WORD, PRESETS, SOURCES_HEADING, keyword_table, lookup
from ..sources.workspace import folder
from ..streaming.resume import answer_stream
from .comparison import compare_runs
from .evaluation import score_run
from .profiling import profile_corpus

SPECS = ["Few Shot|reports/a_answers.jsonl", " Baseline |b.jsonl", "runs/no-cite.eval.json", "a|b|c"]
JUDGE = "Question: {question}\nAnswer: {answer}\n\n{sources}"


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _md5(c) -> F.Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


# -- the corpus, answers and verdicts that several queries share


def _pages(spark, sf) -> DataFrame:
    """Conversations as PDFs of a page a turn, documents as text files, and files of which nothing can be read."""
    turns = _t(spark, sf, "conversations").select(F.concat(F.lit("c/"), "conv_id", F.lit(".pdf")).alias("file"), (F.col("turn") + 1).cast("int").alias("page"), F.when(F.col("role") == "system", " \n").otherwise(F.col("text")).alias("text"))
    texts = _t(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("file"), F.lit(None).cast("int").alias("page"), F.when(F.col("lang") == "fr", "\t ").otherwise(F.col("text")).alias("text"))
    odd = _t(spark, sf, "region").select(F.concat(F.lit("r/"), "r_regionkey", F.lit(".doc")).alias("file"), F.lit(None).cast("int").alias("page"), F.col("r_name").alias("text"))
    broken = _t(spark, sf, "nation").select(F.concat(F.lit("n/"), "n_nationkey", F.lit(".pdf")).alias("file"), F.when(F.col("n_regionkey") > 1, 0).alias("page"), F.lit(None).cast("string").alias("text"))
    return relational.union_all([turns, texts, odd, broken])


def _answers(spark, sf) -> DataFrame:
    """Customers as answers with up to two citations each."""
    n, k, s = F.col("c_nationkey"), F.col("c_custkey"), F.col("c_mktsegment")
    file = (
        F.when(s == "BUILDING", F.concat(F.lit(" corpus\\d\\"), k, F.lit(".aspx.txt\n")))
        .when(s == "AUTOMOBILE", F.concat(F.lit("c/"), n, F.lit(".pdf")))
        .when(s == "MACHINERY", F.concat(F.lit("n/"), n, F.lit(".pdf")))
        .when(s == "HOUSEHOLD", F.concat(F.lit("corpus/c/"), n, F.lit(".pdf")))
    )
    one = F.when(file.isNotNull(), F.struct(file.alias("file"), F.when(s != "HOUSEHOLD", F.pmod(k, F.lit(6)).cast("int")).alias("page"), F.lit("q").alias("quote")))
    more = F.when(n < 12, F.concat(F.lit("r/"), n, F.lit(".doc"))).when(n >= 22, F.lit("  "))
    two = F.when(more.isNotNull(), F.struct(more.alias("file"), F.lit(None).cast("int").alias("page"), F.lit("q").alias("quote")))
    cites = F.array_compact(F.array(one, two))
    return _t(spark, sf, "customer").select(F.concat(F.lit("a"), k).alias("id"), F.col("c_name").alias("answer"), F.when(n != 3, cites).alias("citations"), F.when(n != 4, F.col("c_acctbal").cast("double")).alias("latency_ms"), F.lit(None).cast("struct<prompt:bigint,completion:bigint>").alias("tokens"))


def _grades(spark, sf) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, [" Fully\n", "partially", "NOT_AT_ALL", "maybe"])), (F.pmod(F.col("c_custkey"), F.lit(4)) + 1).cast("int"))
    return _t(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("a"), "c_custkey").alias("id"), said.alias("establishes"), F.lit("").alias("reasoning"), F.lit(0.25).alias("cost_usd"))


def _questions(spark, sf) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ["easy", "medium", "hard"])), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    return _t(spark, sf, "customer").select(F.concat(F.lit("a"), "c_custkey").alias("id"), F.lower("c_mktsegment").alias("domain"), names.alias("difficulty"), F.col("c_name").alias("question"), F.lit("t").alias("ground_truth_answer"), F.col("c_custkey").alias("pos"))


def _judged(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").where("c_nationkey <> 7").select(F.concat(F.lit("a"), k).alias("id"), (k % 2 == 0).alias("relevant"), (k % 5 == 0).alias("hallucination"), (k % 7 == 0).alias("refusal"), F.lit("why").alias("judge_reasoning"), F.when(k % 3 == 0, 0.5).alias("cost_usd"))


def citation_resolution(spark, sf):
    """J8, J9, F7, F14, C1, C3, A21, P6, W1."""
    out = citations.resolve(citations.cited(_answers(spark, sf)), _pages(spark, sf))
    return out.select("id", F.col("cite_pos").cast("int").alias("cite_pos"), "file", "page", "error", "ok", _md5("text").alias("md5"), X.chars(F.col("text")).alias("n"))


def citation_scores(spark, sf):
    """F6, J16, C16, C47, F15, U3."""
    a = _answers(spark, sf)
    out = citations.score(a, citations.resolve(citations.cited(a), _pages(spark, sf)), _grades(spark, sf))
    return out.select("id", "citation_score", "citation_establishes", "citation_resolved", "citation_total", "citation_invalid", "citation_cost_usd", F.array_join("citation_details", "|").alias("details"))


def scored_rows(spark, sf):
    """The rows of a report."""
    report = score_run(_questions(spark, sf), _answers(spark, sf), _pages(spark, sf), _judged(spark, sf), _grades(spark, sf))
    return report.results.select("id", "domain", "difficulty", "answer", "latency_ms", "citation_score", "citation_establishes", "relevant", "hallucination", "refusal", "judge_reasoning", "judge_cost_usd")


def scored_by_domain(spark, sf):
    """The groups of a report."""
    report = score_run(_questions(spark, sf), _answers(spark, sf), _pages(spark, sf), _judged(spark, sf), _grades(spark, sf))
    return report.by_domain


def runs_by_label(spark, sf):
    """Answers and stored evaluations of two runs, one without, by label."""
    a = _answers(spark, sf)
    told = _judged(spark, sf).select("id", "relevant", "hallucination", "refusal", "judge_reasoning", F.when(F.col("refusal"), 0.5).alias("citation_score"))
    out = compare_runs(spark, _questions(spark, sf), [("one", a, told), ("two", a.where("latency_ms > 0"), None)], _pages(spark, sf))
    return out.rows.select("run_label", "id", "relevant", "outcome", "citation_score", F.col("answer_len").alias("answer_len"))


def embedded_payload(spark, sf):
    """Each question with its runs as JSON."""
    a = _answers(spark, sf)
    out = compare_runs(spark, _questions(spark, sf), [("one", a.withColumn("citations", F.lit(None).cast("array<struct<file:string,page:int,quote:string>>")), None)], _pages(spark, sf))
    return sinks.payload_json(out.payload).select("id", F.get_json_object("json", "$.runs[0].answer").alias("answer"), F.get_json_object("json", "$.difficulty").alias("difficulty"), F.get_json_object("json", "$.runs[0].outcome").alias("outcome"))


# -- question sets and corpora


def _sources(spark, sf) -> DataFrame:
    """Orders as questions, each with the options of its lines in groups by return flag."""
    lines = _t(spark, sf, "lineitem")
    end = F.when(F.col("l_linestatus") == "O", ".pdf").otherwise(".PDF")
    option = F.struct(F.col("l_linenumber").alias("k"), F.concat(F.lit("n"), F.pmod("l_suppkey", F.lit(7)), end).alias("file"), F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("int")).alias("page"))
    group = lines.groupBy("l_orderkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(option)), lambda o: F.struct(o["file"], o["page"])).alias("any_of"))
    held = group.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "any_of"))), lambda g: F.struct(g["any_of"])).alias("ground_truth_sources"))
    rank = F.element_at(F.array(*map(F.lit, ["hard", "medium", "easy", "easy", "other"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    return _t(spark, sf, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat(F.lit("q"), "o_orderkey").alias("id"), F.lower("o_orderstatus").alias("domain"), rank.alias("difficulty"), F.col("o_orderpriority").alias("question"), F.concat(F.when(F.col("o_totalprice") > 150000, "٣ x").otherwise("none"), "o_orderstatus").alias("ground_truth_answer"), "ground_truth_sources", F.col("o_orderkey").alias("pos"))


def _manifest(spark) -> DataFrame:
    return spark.createDataFrame([(f"n{i}.pdf", f"http://h/{i}") for i in (0, 2, 3, 5)], "rel string, url string")


def question_rows(spark, sf):
    """P4, A33, C6, C9, C27, C44, C45, J11."""
    out = profile.question_rows(_sources(spark, sf), _manifest(spark))
    return out.select("id", "q_len", "a_len", "num_groups", "num_sources", "has_number", "null_pages", "in_manifest", F.array_join("source_kinds", ",").alias("kinds"), F.aggregate("page_numbers", F.lit(0), lambda a, x: a + x).alias("pages"))


def citation_mix(spark, sf):
    """Options by kind and questions of several groups, by difficulty."""
    return profile.citation_mix(profile.question_rows(_sources(spark, sf), _manifest(spark)))


def missing_files(spark, sf):
    """Cited files that a manifest lacks, in their order."""
    return profile.missing_files(_sources(spark, sf), _manifest(spark)).withColumn("n", X.chars(F.col("file")))


def distinct_sources(spark, sf):
    """The distinct files of all questions, and their kinds."""
    files = profile.options(_sources(spark, sf)).select("file")
    out = relational.distinct_union([files, _manifest(spark).select(F.col("rel").alias("file"))])
    return out.select("file", X.cited_kind(F.col("file")).alias("cited_kind"), X.kind(F.col("file")).alias("kind"))


def answer_matches(spark, sf):
    """Each order's groups against a citation of the least file among its lines."""
    first = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.pmod("l_suppkey", F.lit(7))).alias("k"))
    first = first.select(F.concat(F.lit("q"), "l_orderkey").alias("id"), F.array(F.struct(F.concat(F.lit("corpus/n"), "k", F.lit(".pdf")).alias("file"), F.lit(30).alias("page"))).alias("citations"))
    out = citations.legacy_score(_sources(spark, sf).join(first, "id", "left"))
    return out.select("id", "legacy_score", "legacy_establishes", "legacy_resolved", "legacy_total", "legacy_invalid", F.array_join("legacy_details", "|").alias("details"))


def corpus_files(spark, sf):
    """Parts of the paths of a manifest."""
    manifest = _t(spark, sf, "pages").select(F.concat(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("?"), F.lit(1)), F.lit(".Pdf")).alias("rel"), "url", "page_id")
    sizes = _t(spark, sf, "pages").select(F.concat(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("?"), F.lit(1)), F.lit(".Pdf")).alias("rel"), X.chars(F.col("html")).alias("n")).groupBy("rel").agg(F.max("n").alias("size"))
    out = profile.corpus_files(manifest.select("rel", "url"), sizes, [(".org", "org"), ("/en/", "english")], "else")
    return out.select("rel", "domain", "subdir", "kind", "host", "name", "size")


def corpus_profile(spark, sf):
    """The profile of a corpus, its domains by label."""
    manifest = _t(spark, sf, "supplier").select(F.concat(F.element_at(F.array(*map(F.lit, ["car", "life", "long-term-care", "x"])), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int")), F.lit("/"), "s_suppkey", F.when(F.col("s_nationkey") > 9, ".pdf").otherwise(".aspx.txt")).alias("rel"), F.col("s_name").alias("url"))
    q = _questions(spark, sf).withColumn("ground_truth_sources", F.lit(None).cast("array<struct<any_of:array<struct<file:string,page:int>>>>"))
    out = profile_corpus(spark, manifest, None, q, _t(spark, sf, "documents").select("text"), _t(spark, sf, "supplier").select(F.col("s_name").alias("file"), (F.col("s_nationkey") - 5).alias("pages")))
    return out["kinds_by_domain"]


def page_profile(spark, sf):
    """Page counts of files, those that can't be read not counted."""
    return profile.page_profile(readers.page_counts(_pages(spark, sf).where("endswith(file, '.pdf')")))


def keyword_classes(spark, sf):
    """Names by the keywords that they contain."""
    words = F.array(*map(F.lit, KEYWORDS))
    names = _t(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.element_at(words, (F.pmod("p_partkey", F.lit(len(KEYWORDS))) + 1).cast("int")), F.when(F.col("p_size") > 25, " טופס").otherwise("")).alias("name"), F.col("p_partkey").alias("pos"))
    return profile.keyword_counts(names, keyword_table(spark)).select("label", "n")


# -- files


def _items(spark, sf) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), F.lit("car").alias("domain"), F.lit("easy").alias("difficulty"), F.col("text").alias("question"), F.substring("text", 1, 9).alias("ground_truth_answer"), F.array(F.struct(F.array(F.struct(F.lit("f.pdf").alias("file"), F.col("item_id").cast("int").alias("page"))).alias("any_of"))).alias("ground_truth_sources"), F.col("item_id").alias("pos"))


def _json_file(df: DataFrame, path: str, wrapper: str | None) -> str:
    """One JSON file with all rows in the order of ``pos``; for question sets, which one file holds."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*[c for c in df.columns if c != "pos"]).alias("r")))), lambda x: x["r"])
    body = F.to_json(rows if wrapper is None else F.struct(rows.alias(wrapper)))
    df.agg(body.alias("value")).coalesce(1).write.text(path)
    return path


def questions_file(spark, sf):
    """An array under ``questions``, of which one id comes twice, and a bare one, written and read."""
    items = _items(spark, sf)
    again = items.where("pos = 3").withColumns({"pos": F.lit(10_000_000).cast("bigint"), "question": F.lit("again")})
    held = readers.read_questions(spark, _json_file(items.unionByName(again), folder(spark, "questions"), "questions"))
    bare = readers.read_questions(spark, _json_file(items, folder(spark, "questions"), None))
    both = relational.union_all([held.withColumn("form", F.lit("held")), bare.withColumn("form", F.lit("bare"))])
    page = F.col("ground_truth_sources")[0]["any_of"][0]["page"]
    return both.select("form", "id", F.col("pos").cast("bigint").alias("pos"), _md5("question").alias("md5"), "ground_truth_answer", page.alias("page"))


def examples_file(spark, sf):
    """Examples under ``few_shot`` as messages before each question, shown as text."""
    few = _t(spark, sf, "region").select(F.concat(F.lit("e"), "r_regionkey").alias("id"), F.lit("car").alias("domain"), F.lit("easy").alias("difficulty"), F.col("r_name").alias("question"), F.lower("r_name").alias("answer"), F.when(F.col("r_regionkey") > 1, F.array(F.struct(F.lit("f.pdf").alias("file"), F.when(F.col("r_regionkey") > 2, F.col("r_regionkey")).alias("page")))).alias("citations"), F.col("r_regionkey").alias("pos"))
    examples = readers.read_examples(spark, _json_file(few, folder(spark, "examples"), "few_shot"))
    out = runs.build_messages(_items(spark, sf), examples, "Answer.")
    return out.select("id", F.size("messages").alias("n"), _md5(sinks.prompt_preview(F.col("messages"))).alias("md5"))


def _log(spark, records: DataFrame) -> str:
    """A JSONL file of one part in the order of ``pos``."""
    path = folder(spark, "log")
    sinks.write_jsonl(records, path)
    return path


def answers_log(spark, sf):
    """A log with blank lines and repeated ids; the last record at the first one's place."""
    path = folder(spark, "log")
    lines = _t(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.when(F.col("item_id") < 5, 2).otherwise(1))).alias("k"), "text")
    record = F.to_json(F.struct(F.concat(F.lit("q"), "item_id").alias("id"), F.concat("text", F.col("k")).alias("answer"), F.col("item_id").cast("double").alias("latency_ms")))
    line = F.when(F.col("k") == 1, "  ").otherwise(record)
    lines.repartition(1).sortWithinPartitions("k", "item_id").select(line.alias("value")).write.text(path)
    out = readers.read_answers(spark, path, "run")
    return out.select("run_label", "id", F.col("pos").cast("bigint").alias("pos"), _md5("answer").alias("md5"), "latency_ms")


def log_preset(spark, sf):
    """The preset of a run: given, told by the first record of its log, or by its label."""
    log = _t(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), F.lit("x").alias("answer"), F.when(F.col("item_id") > 0, "concise").alias("preset"), F.when(F.col("item_id") == 0, 10).alias("few_shot_examples"), F.col("item_id").alias("pos"))
    told = readers.preset_of_log(readers.read_records(spark, _log(spark, log)))
    labels = F.element_at(F.array(*map(F.lit, ["The Baseline", "No Cite 2", "concise no-cite", "Concise", "few shot", "Few-Shot + x", "other", ""])), (F.pmod("o_orderkey", F.lit(8)) + 1).cast("int"))
    rows = _t(spark, sf, "orders").select("o_orderkey", labels.alias("label"), F.when(F.col("o_orderstatus") == "O", "").when(F.col("o_orderstatus") == "P", "given").alias("explicit"))
    rows = relational.for_each(rows, told.withColumnRenamed("preset", "of_log"))
    by_label = X.resolve_preset(F.col("explicit"), F.lit(None).cast("string"), F.col("label"))
    files = dict(zip(PRESETS, ("examples.json", "examples.json", "examples_no_cite.json")))
    return rows.select("o_orderkey", by_label.alias("by_label"), X.resolve_preset(F.col("explicit"), F.col("of_log"), F.col("label")).alias("preset"), lookup(by_label, files, F.lit("none")).alias("examples"))


def resumed_log(spark, sf):
    """A log is read for its ids, the questions that it lacks are answered and appended."""
    path, q = folder(spark, "log"), _items(spark, sf)
    answer = lambda d: d.select("id", F.upper("question").alias("answer"), *runs.answer_record("concise", "e.json", 10))
    sinks.append_answers(spark, q.where("pos < 7"), readers.answered_ids(spark, path), answer, path)
    sinks.append_answers(spark, q, readers.answered_ids(spark, path), lambda d: runs.failed_record(d, F.lit("HTTP 500")), path)
    out = readers.read_answer_log(spark, path)
    return out.select("id", _md5("answer").alias("md5"), "preset", "examples_file", "few_shot_examples", "endpoint_error")


def streamed_log(spark, sf):
    """Questions arrive as files; each is answered once, those in the log never."""
    source, log = folder(spark, "arriving"), folder(spark, "log")
    q = _items(spark, sf).select("id", "question", "pos")
    q.where("pos < 5").select("id", F.lit("old").alias("answer")).write.json(log)
    q.unionByName(q.where("pos > 9")).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(source)
    answer_stream(stream, lambda d: d.select("id", F.lower("question").alias("answer")), log, folder(spark, "stream")).awaitTermination()
    return readers.read_answer_log(spark, log).select("id", _md5("answer").alias("md5"))


def report_file(spark, sf):
    """A run's report written as JSON, its results read again by id; a report that isn't there has none."""
    report = score_run(_items(spark, sf), _items(spark, sf).select("id", F.col("question").alias("answer"), F.lit(None).cast("array<struct<file:string,page:int,quote:string>>").alias("citations"), F.col("pos").cast("double").alias("latency_ms")), _pages(spark, sf))
    path = folder(spark, "report")
    text = sinks.report_json(report.summary, report.results.drop("pos", "citations", "citation_details"), {"difficulty": report.by_difficulty, "domain": report.by_domain}, "run")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    out = relational.union_all([readers.read_report(spark, path), readers.read_report(spark, path + "-none"), readers.read_report(spark, None)])
    return out.select("id", _md5("answer").alias("md5"), "latency_ms", "citation_score", "citation_establishes", "relevant")


def console_summary(spark, sf):
    """A report as lines of text."""
    report = score_run(_questions(spark, sf), _answers(spark, sf), _pages(spark, sf), _judged(spark, sf), _grades(spark, sf))
    lines = sinks.summary_text(report.summary, report.by_difficulty, "all").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "i bigint, line string")


def manifest_file(spark, sf):
    """An object of path and URL."""
    path = folder(spark, "manifest")
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("x/"), "n_name", F.lit(".pdf")), F.concat(F.lit("http://h/"), "n_nationkey"))))
    _t(spark, sf, "nation").agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(path)
    return profile.corpus_files(readers.read_manifest(spark, path)).select("rel", "url", "domain", "kind", "name")


def _text_files(spark, sf) -> str:
    """A file for each nation, with bytes that are no UTF-8."""
    path = folder(spark, "files")
    raw = F.concat(F.col("n_name").cast("binary"), F.unhex(F.lit("C328EFBFBD20FF")), F.when(F.col("n_nationkey") > 9, F.encode(F.lit("é\f2"), "UTF-8")).otherwise(F.unhex(F.lit("E282"))))
    _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), raw.cast("string").alias("value")).write.partitionBy("k").text(path)
    return path


def file_texts(spark, sf):
    """Texts of files, undecodable bytes replaced and dropped, and their sizes."""
    path = _text_files(spark, sf)
    key = F.regexp_extract("path", r"k=(\d+)/", 1).cast("int").alias("k")
    replaced, dropped = (readers.read_texts(spark, path, e).select(key, F.col("text").alias(e)) for e in ("replace", "ignore"))
    return replaced.join(dropped, "k").join(readers.file_sizes(spark, path).select(key, "size"), "k").select("k", _md5("replace").alias("replaced"), _md5("ignore").alias("dropped"), "size")


def pdf_text(spark, sf):
    """Pages of files by an injected parser; what it can't read has none."""

    def parser(raw: bytes) -> list[str]:
        if b"\f" not in raw:
            raise ValueError("no page")
        return raw.decode("utf-8", "ignore").split("\f")

    pages = external.pdf_pages(spark, _text_files(spark, sf), parser, "*.txt")
    return pages.select(F.regexp_extract("file", r"k=(\d+)/", 1).cast("int").alias("k"), "page", _md5("text").alias("md5"))


# -- prompts and replies


def judge_prompt(spark, sf):
    """What a judge is shown."""
    a = _answers(spark, sf)
    r = citations.resolve(citations.cited(a), _pages(spark, sf)).where("ok")
    shown = r.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cite_pos", "file", "page", "text"))).alias("r"))
    rows = a.join(shown, "id", "left")
    blocks = F.coalesce(X.source_blocks(F.transform("r", lambda x: F.struct(x["file"], x["page"], x["text"]))), F.lit(""))
    empty = F.when(F.endswith("answer", F.lit("0")), "").otherwise(F.col("answer"))
    return rows.select("id", _md5(X.fill(JUDGE, question=F.lit("{answer}"), answer=X.shown_answer(empty), sources=blocks)).alias("md5"))


def reply_verdicts(spark, sf):
    """Replies as verdicts."""
    k = F.col("event_id")
    body = F.concat(F.lit('{"relevant": '), (k % 2).cast("string"), F.lit(', "hallucination": "'), F.when(k % 3 == 0, "yes").otherwise(""), F.lit('", "reasoning": "r'), k.cast("string"), F.lit('"}'))
    raw = F.when(k % 11 == 0, "no JSON").when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    out = external.judged(_t(spark, sf, "events").select("event_id", raw.alias("raw"), ((F.col("event_id") % 30) / 20).alias("confidence")))
    return out.select("event_id", "relevant", "hallucination", "refusal", "reasoning", V.in_range(F.col("confidence")).alias("in_range"))


def stored_grades(spark, sf):
    """Grades of citations from what a judge says, their worth, and a stored cost."""
    said = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ["FULLY", "Partially\n", "not_at_all", "full", ""])), F.substring("o_orderpriority", 1, 1).cast("int"))).alias("establishes"), F.col("o_custkey").alias("c_custkey"))
    rows = external.with_stored(said, _t(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal"), ["c_custkey"])
    g = V.grade(F.col("establishes"))
    return rows.select("o_orderkey", g.alias("grade"), lookup(g, ESTABLISHES, F.lit(0.0)).alias("score"), "c_acctbal")


def endpoint_call(spark, sf):
    """Rows sent in batches to a function that stands for a model, and the cost of its tokens."""
    ask = lambda p: p.assign(answer=p["text"].str.slice(0, 20), prompt=p["text"].str.len(), completion=20)[["item_id", "answer", "prompt", "completion"]]
    out = external.call(_t(spark, sf, "benchmark").select("item_id", "text"), ask, "item_id bigint, answer string, prompt bigint, completion bigint", calls=2)
    return out.select("item_id", "answer", C.token_cost(F.col("prompt"), F.col("completion")).alias("cost_usd"))


def prompt_specs(spark, sf):
    """Specs of presets, labels of runs, names of models and endpoints, as a table."""
    specs = runs.prompt_specs({p: f"{p}.md" for p in PRESETS}, "few_shot", {"default": "e.json"}, {"default": 10})
    rows = [("spec", s["preset"], s["prompt"], s["examples_file"], s["message_count"]) for s in specs]
    rows += [("label", *readers.labelled(s), None, i) for i, s in enumerate(SPECS)]
    rows += [("model", runs.model_name(m, "prov"), runs.endpoint(f"http://{m}/", "/ask"), None, None) for m in ("m", "prov/m")]
    return spark.createDataFrame(rows, "what string, a string, b string, c string, n bigint")


# -- columns


def sort_keys(spark, sf):
    """What each of the ten columns is sorted by."""
    r = F.struct((F.col("quality") == 1).alias("relevant"), (F.col("toxic") == 1).alias("hallucination"), (F.col("quality") + F.col("toxic") == 0).alias("refusal"), F.when(F.col("quality") == 1, 0.5).alias("citation_score"), F.when(F.col("toxic") == 0, F.col("doc_id").cast("double")).alias("latency_ms"), F.struct(F.col("doc_id").alias("prompt"), F.when(F.col("toxic") == 0, F.lit(5).cast("bigint")).alias("completion")).alias("tokens"))
    rows = _t(spark, sf, "documents").select("doc_id", "lang", "source").join(_t(spark, sf, "labels"), "doc_id", "left").withColumn("runs", F.when(F.col("quality").isNotNull(), F.array(r)).otherwise(F.array().cast("array<struct<relevant:boolean,hallucination:boolean,refusal:boolean,citation_score:double,latency_ms:double,tokens:struct<prompt:bigint,completion:bigint>>>")))
    rows = rows.withColumns({"id": F.col("doc_id").cast("string"), "domain": F.col("source"), "difficulty": lookup("lang", {"de": "easy", "en": "medium", "es": "hard"}, F.lit("none"))})
    names = ["id", "domain", "difficulty", "outcome", "relevant", "hallucination", "refusal", "citation", "latency", "tokens", "what"]
    return rows.select(*[compare.sort_key(n).alias(f"by_{n}") for n in names])


def unit_columns(spark, sf):
    """Percent, bytes, guarded ratios, clamps and cycles."""
    n, x = F.col("l_linenumber"), F.col("l_extendedprice")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.percent(F.col("l_discount")).alias("percent"), C.kilobytes(x).alias("kb"), C.megabytes(x).alias("mb"), C.ratio(F.col("l_quantity"), n - 3).alias("ratio"), C.clamp(x, 1000.0, 30000.0).alias("clamped"), C.cycled(n, 3).alias("color"))


def titled(spark, sf):
    """Labels in title case, from the table of domains, and escaped for a page."""
    codes = F.element_at(F.array(*map(F.lit, [*DOMAIN_LABELS, "a-new_code"])), (F.pmod("o_orderkey", F.lit(len(DOMAIN_LABELS) + 1)) + 1).cast("int"))
    page = F.replace(X.escape_html(F.concat(F.lit("<\"a\" & 'b'>\n"), "o_orderpriority"), quotes=False), F.lit("\n"), F.lit("<br>"))
    return _t(spark, sf, "orders").select("o_orderkey", X.title(F.col("o_orderpriority")).alias("title"), lookup(codes, DOMAIN_LABELS).alias("label"), page.alias("page"))


def cited_answers(spark, sf):
    """Answers followed by their sources."""
    return _answers(spark, sf).select("id", _md5(X.with_sources(F.col("answer"), F.col("citations"), SOURCES_HEADING, PAGE_WORD)).alias("md5"))


def first_questions(spark, sf):
    """The first question, and the first few, before anything is joined."""
    q = _questions(spark, sf).select("id", "domain", "pos")
    return relational.union_all([relational.first_rows(q, n).withColumn("asked", F.lit(n)) for n in (1, 3)])


def metric_rates(spark, sf):
    """How often a fractional metric isn't zero, by difficulty."""
    rows = _questions(spark, sf).join(_answers(spark, sf).select("id", "latency_ms"), "id")
    return metrics.by_difficulty(rows.withColumn("metric", F.greatest("latency_ms", F.lit(0.0))), "metric", "domain")


QUERIES = {
    f.__name__: f
    for f in (
        citation_resolution, citation_scores, scored_rows, scored_by_domain, runs_by_label, embedded_payload, question_rows, citation_mix, missing_files,
        distinct_sources, answer_matches, corpus_files, corpus_profile, page_profile, keyword_classes, questions_file, examples_file, answers_log,
        log_preset, resumed_log, streamed_log, report_file, console_summary, manifest_file, file_texts, pdf_text, judge_prompt, reply_verdicts,
        stored_grades, endpoint_call, prompt_specs, sort_keys, unit_columns, titled, cited_answers, first_questions, metric_rates,
    )
}

"""Registered queries: each operator on the driver's tables, whole tables only. Keys are those of ``sql.ORACLE``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import conditions as C
from ..functions import text as X
from ..functions import verdicts as V
from ..operators import citations, compare, metrics, profile, relational, runs
from ..sources.constants import lookup
from . import analytic_queries, ordered_queries, scoring_queries, search_queries, stream_queries, table_queries

#: Needles of the keyword queries, on URLs.
NEEDLES = [("example.com", "com", 0), ("example.net", "net", 1), ("/en/", "english", 2), ("utm_source", "campaign", 3)]
DIFFICULTY_OF = {"de": "easy", "en": "medium", "es": "hard"}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _verdicts(spark, sf) -> DataFrame:
    labels = _t(spark, sf, "labels")
    wrong = F.col("toxic") == 1
    return labels.select("doc_id", V.overridden(F.col("quality") == 1, wrong).alias("relevant"), wrong.alias("hallucination"), (F.col("quality") + F.col("toxic") == 0).alias("refusal"))


def _results(spark, sf) -> DataFrame:
    """Documents as questions, labels as verdicts, lengths as latencies."""
    docs = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    out = docs.join(_verdicts(spark, sf), "doc_id", "left")
    return out.select("doc_id", "lang", "source", "relevant", "hallucination", "refusal", F.col("n_chars").cast("double").alias("latency_ms"), F.when(F.col("relevant"), 1.0).otherwise(0.0).alias("citation_score"), (F.col("n_chars") / 1e6).alias("judge_cost_usd"))


def judged_metrics_by_lang(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(_verdicts(spark, sf), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), A.rate(F.col("relevant")).alias("relevance_rate"), A.rate(F.col("hallucination")).alias("hallucination_rate"), A.mean(F.col("n_chars")).alias("len_avg"), A.upper_median("n_chars").alias("len_p50"))


def run_summary(spark, sf):
    return metrics.summary(_results(spark, sf))


def metrics_by_source(spark, sf):
    return metrics.by_group(_results(spark, sf), F.col("source"), "source")


def upper_median_by_type(spark, sf):
    return metrics.medians(_t(spark, sf, "events"), ["event_type"], F.col("value"), upper="p50")


def true_median_by_type(spark, sf):
    events = _t(spark, sf, "events")
    return metrics.medians(events, ["event_type"], F.col("value"), true="p50").join(events.groupBy("event_type").agg(A.mean_truthy(F.col("value")).alias("mean_nonzero")), "event_type")


def left_outer_unjudged(spark, sf):
    rows = relational.left_outer(_t(spark, sf, "documents").select("doc_id", "lang"), _verdicts(spark, sf), "doc_id")
    return rows.select("doc_id", "lang", F.coalesce(F.col("relevant").cast("string"), F.lit("(missing)")).alias("relevant"))


def resume_pending(spark, sf):
    return runs.pending(_t(spark, sf, "documents").select(F.col("doc_id").alias("id")), _t(spark, sf, "labels").select(F.col("doc_id").alias("id")))


def coverage_flag(spark, sf):
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return relational.flagged(orders, _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k", "has_lines")


def set_difference(spark, sf):
    return relational.missing(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k").distinct()


def set_intersection(spark, sf):
    return relational.present(_t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), _t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), "k").distinct()


def outcome_class(spark, sf):
    rows = _results(spark, sf)
    out = C.outcome(F.col("relevant"), F.col("hallucination"), F.col("refusal"))
    return rows.select("doc_id", out.alias("outcome"), C.card_class(out).alias("card"), C.cell_class(F.col("citation_score")).alias("cell"))


def rate_classes(spark, sf):
    rows = _results(spark, sf).groupBy("source").agg(A.rate(F.col("relevant")).alias("relevance"), A.rate(F.col("hallucination")).alias("hallucination"))
    return rows.select("source", C.rate_class(F.col("relevance"), True).alias("relevance_class"), C.rate_class(F.col("hallucination"), False).alias("hallucination_class"))


def crosstab_zero_filled(spark, sf):
    rows = _t(spark, sf, "documents").select("source", "lang")
    return profile.cross_tab(rows, "source", "lang", ["de", "en", "es", "fr", "it"])


def keyword_frequency(spark, sf):
    needles = spark.createDataFrame(NEEDLES, "needle string, label string, needle_pos int")
    pages = _t(spark, sf, "pages").select("url", F.col("page_id").alias("pos"))
    return profile.keyword_counts(pages, needles, "url").select("label", "n", F.col("first_pos.pos").alias("first_page"))


def groups_satisfied(spark, sf):
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") < 25).alias("matched"))
    return citations.groups_satisfied(lines, parts, ["l_orderkey"], "l_linenumber", F.col("l_partkey") == F.col("p_partkey"))


def legacy_scores(spark, sf):
    """Turns of a conversation as groups of one option each, matched against all its roles as citations of page 2."""
    turns = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(F.array(F.struct(x["role"].alias("file"), F.when(x["turn"] % 2 == 0, x["turn"].cast("int")).alias("page"))).alias("any_of"))).alias("ground_truth_sources"))
    cites = F.transform("ground_truth_sources", lambda g: F.struct(g["any_of"][0]["file"].alias("file"), F.lit(2).alias("page")))
    out = citations.legacy_score(turns.withColumn("citations", cites))
    return out.select("conv_id", "legacy_score", "legacy_establishes", F.col("legacy_total").cast("bigint").alias("groups"))


def script_ratio(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.groupBy("lang").agg(A.or_zero(F.avg(X.script_ratio(F.col("text"), "[à-ÿÀ-ß]"))).alias("ratio"))


def has_number(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang").agg(F.count_if(X.has_digit(F.col("text"))).alias("with_number"), F.count("*").alias("n"))


def truncate_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.chars(X.truncate(F.col("text"))).alias("n"), F.md5(X.truncate(F.col("text")).cast("binary")).alias("md5"))


def host_class(spark, sf):
    classes = [("spam-farm.example", "spam"), ("example.com", "com"), ("example", "other example")]
    return _t(spark, sf, "pages").groupBy(X.first_class(F.col("url"), classes, "other").alias("host")).agg(F.count("*").alias("n"))


def json_field(spark, sf):
    v = V.parse_object(F.concat(F.lit("reply: "), F.col("props")))
    return _t(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def json_truthiness(spark, sf):
    raw = F.concat(F.lit('{"relevant": '), F.element_at(F.array(*map(F.lit, ["true", '"false"', "0", "1", "null", '""', "[]"])), (F.col("event_id") % 7 + 1).cast("int")), F.lit("}"))
    return _t(spark, sf, "events").select("event_id", V.parse_verdict(raw)["relevant"].alias("relevant"))


def ordered_messages(spark, sf):
    out = runs.ordered_messages(_t(spark, sf, "conversations"))
    return out.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").cast("binary")).alias("md5"), F.size("messages").cast("bigint").alias("turns"))


def last_wins(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max_by("value", "event_id").alias("value"))


def dedupe_positions(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), "event_type", "value")
    return relational.last_wins(e, "user_id", "pos")


def first_n(spark, sf):
    docs, labels = _t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels").select("doc_id", "quality")
    return relational.first_rows(relational.inner(docs, labels, "doc_id"), 25, "doc_id")


def token_cost(spark, sf):
    turns = _t(spark, sf, "conversations").withColumn("n", X.chars(F.col("text")))
    user = F.sum(F.when(F.col("role") == "user", F.col("n")).otherwise(0))
    said = F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0))
    return turns.groupBy("conv_id").agg(C.token_cost(user, said).alias("cost_usd"))


def replicate_agreement(spark, sf):
    a = _t(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("relevant"), F.col("toxic").alias("hallucination"))
    b = a.select("id", F.when(F.col("id") % 3 == 0, 1 - F.col("relevant")).otherwise(F.col("relevant")).alias("relevant"), F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("hallucination")).alias("hallucination"))
    return compare.agreement(a, b, "relevant", "hallucination")


def histogram_25(spark, sf):
    return profile.histogram(_t(spark, sf, "orders"), "o_totalprice", 25, 0.0, 500000.0)


def box_stats(spark, sf):
    return profile.length_boxes(_t(spark, sf, "documents"), "lang", "n_chars")


def sort_nulls(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.asc_nulls_last("quality"), "doc_id")


def global_and_grouped(spark, sf):
    rows = _results(spark, sf).select("lang", "source", "relevant", "latency_ms")
    return metrics.by_groupings(rows, ["lang", "source"], F.count("*").alias("n"), A.rate(F.col("relevant")).alias("relevance_rate"), A.mean(F.col("latency_ms")).alias("latency_avg"))


def rate_by_category(spark, sf):
    rows = _results(spark, sf).withColumn("difficulty", lookup("lang", DIFFICULTY_OF, F.lit("other"))).withColumn("flag", F.col("relevant").cast("int"))
    return metrics.by_difficulty(rows, "flag", "source")


def path_normalise(spark, sf):
    path = X.normalise_path(F.concat(F.lit(" corpus\\"), F.regexp_replace("url", "^https?://", ""), F.lit(".aspx.txt ")))
    return _t(spark, sf, "pages").select("page_id", path.alias("path"), X.component(path, 1).alias("first"), X.base_name(path).alias("name"), X.suffix(path).alias("suffix"))


def all_any_quantifiers(spark, sf):
    return profile.quantified(_t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") > 10)


def first_pages_concat(spark, sf):
    out = citations.first_pages(_t(spark, sf, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("md5"), X.chars(F.col("text")).alias("n"), "pages")


def multi_run_union_compare(spark, sf):
    labels = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars", "text"), "doc_id")
    base = lambda flag, name: labels.select(F.lit(name).alias("run_label"), (F.col(flag) == 1).alias("relevant"), (F.col(flag) == 0).alias("hallucination"), F.lit(False).alias("refusal"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).otherwise(0.0).alias("latency_ms"), F.col("text").alias("answer"), F.col(flag).cast("double").alias("citation_score"))
    return metrics.run_stats(relational.union_all([base("quality", "a"), base("toxic", "b").drop("refusal")]))


def explorer_filter_sort(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.col("source").alias("domain"), "lang", F.col("text").alias("question"))
    labels = _verdicts(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.array(F.struct("relevant", "hallucination", "refusal", F.lit(0.5).alias("citation_score"), F.lit(None).cast("double").alias("latency_ms"), F.lit(None).cast("struct<prompt:bigint,completion:bigint>").alias("tokens"))).alias("runs"))
    q = docs.join(labels, "id").withColumn("difficulty", F.when(F.col("lang") == "de", "easy").when(F.col("lang") == "en", "medium").when(F.col("lang") == "es", "hard").otherwise("unknown"))
    found = compare.explore(q, search="THAN", shown="relevant")
    return compare.arrange(found, "difficulty", ascending=False).select("id", "difficulty", C.primary_outcome(F.col("runs")).alias("outcome"))


def payload_runs(spark, sf):
    """All documents in two runs; the second has answers to those of good quality only."""
    q = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.col("source").alias("domain"), F.col("lang").alias("difficulty"), F.lit("q").alias("question"))
    v, labels = _verdicts(spark, sf), _t(spark, sf, "labels")
    answer = lambda name, rows: rows.select(F.lit(name).alias("run_label"), F.col("doc_id").cast("string").alias("id"), F.lit("a").alias("answer"), F.array().cast("array<string>").alias("citations"), F.col("doc_id").cast("double").alias("latency_ms"), F.lit(None).cast("struct<prompt:bigint,completion:bigint>").alias("tokens"))
    verdict = v.select(F.lit("a").alias("run_label"), F.col("doc_id").cast("string").alias("id"), "relevant", "hallucination", "refusal", F.lit("").alias("judge_reasoning"))
    few = spark.createDataFrame([("a", 0), ("b", 1)], "run_label string, run_pos int")
    rows = compare.run_rows(q, few, relational.union_all([answer("a", labels), answer("b", labels.where("quality = 1"))]), verdict)
    out = compare.payload(rows)
    return out.select("id", F.size("runs").cast("bigint").alias("n"), F.col("runs")[0]["outcome"].alias("first"), F.col("runs")[1]["answer"].alias("second"))


def text_profile(spark, sf):
    return profile.text_profile(_t(spark, sf, "documents"))


def corpus_totals(spark, sf):
    files = _t(spark, sf, "documents").select(F.col("source").alias("domain"), F.col("n_chars").alias("size"))
    rows = _t(spark, sf, "labels").select((F.col("quality") == 1).alias("has_number"))
    return profile.totals(files, rows)


def kinds_by_domain(spark, sf):
    files = _t(spark, sf, "pages").select(F.regexp_extract("url", r"example\.(\w+)/", 1).alias("domain"), X.kind(F.regexp_replace("url", r"\.html.*", ".PDF")).alias("kind"))
    return profile.kinds_by_domain(files, {"com": "Commercial", "net": "Network"})


def domain_gaps(spark, sf):
    """Nations of suppliers as domains of files, those of customers as domains of questions."""
    files = _t(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("domain"), "s_suppkey")
    return profile.domain_gaps(files, _t(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("domain")))


def axis_headroom(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type").agg(A.headroom(F.col("value")).alias("top"), A.headroom(F.col("value") * 1000).alias("far"), A.headroom(F.lit(None).cast("double")).alias("none"))


def escaped(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(X.escape_html(F.col("html")).cast("binary")).alias("md5"))


QUERIES = {
    f.__name__: f
    for f in (
        judged_metrics_by_lang, run_summary, metrics_by_source, upper_median_by_type, true_median_by_type, left_outer_unjudged, resume_pending, coverage_flag,
        set_difference, set_intersection, outcome_class, rate_classes, crosstab_zero_filled, keyword_frequency, groups_satisfied, legacy_scores, script_ratio,
        has_number, truncate_text, host_class, json_field, json_truthiness, ordered_messages, last_wins, dedupe_positions, first_n, token_cost,
        replicate_agreement, histogram_25, box_stats, sort_nulls, global_and_grouped, rate_by_category, path_normalise, all_any_quantifiers,
        first_pages_concat, multi_run_union_compare, explorer_filter_sort, payload_runs, text_profile, corpus_totals, kinds_by_domain, domain_gaps,
        axis_headroom, escaped,
    )
} | scoring_queries.QUERIES | stream_queries.QUERIES | ordered_queries.QUERIES | table_queries.QUERIES | search_queries.QUERIES | analytic_queries.QUERIES

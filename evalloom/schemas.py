"""Explicit schemas of all tables; nothing is inferred from files."""

from __future__ import annotations

SOURCE = "struct<file: string, page: int>"
CITATION = "struct<file: string, page: int, quote: string>"

QUESTIONS = f"id string, domain string, difficulty string, question string, ground_truth_answer string, ground_truth_sources array<struct<any_of: array<{SOURCE}>>>"
ANSWERS = (
    f"id string, answer string, citations array<{CITATION}>, latency_ms double, tokens struct<prompt: bigint, completion: bigint>, few_shot_examples int, "
    "examples_file string, preset string, endpoint_error string, domain string, confidence double, cost_usd double"
)
VERDICTS = "run_label string, id string, relevant boolean, hallucination boolean, refusal boolean, judge_reasoning string, cost_usd double"
CITATION_VERDICTS = "run_label string, id string, establishes string, reasoning string, cost_usd double"
RESULTS = (
    "id string, domain string, difficulty string, question string, ground_truth_answer string, answer string, latency_ms double, citation_score double, "
    "citation_establishes string, citation_resolved int, citation_total int, citation_invalid int, relevant boolean, hallucination boolean, refusal boolean, "
    "judge_reasoning string, judge_cost_usd double"
)
_GROUP = "struct<count: bigint, relevance_rate: double, hallucination_rate: double, refusal_rate: double, citation_accuracy: double, latency_ms_avg: double>"
REPORT = (
    "run_label string, total bigint, relevance_rate double, hallucination_rate double, refusal_rate double, citation_accuracy double, latency_ms_avg double, "
    f"latency_ms_p50 double, judge_cost_usd double, by_difficulty map<string, {_GROUP}>, by_domain map<string, {_GROUP}>, results array<struct<{RESULTS.replace(' string', ': string').replace(' double', ': double').replace(' int', ': int').replace(' boolean', ': boolean')}>>"
)
MANIFEST = "rel string, url string"
CORPUS_FILES = "rel string, domain string, subdir string, kind string, size bigint, url string, host string, name string"
CORPUS_PAGES = "file string, page int, text string"
EXAMPLES = f"id string, domain string, difficulty string, question string, answer string, citations array<{SOURCE}>"
MESSAGES = "array<struct<role: string, content: string>>"

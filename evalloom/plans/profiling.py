"""Profile a corpus and its question set: the tables behind each chart."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import profile
from ..sources.constants import keyword_table


def profile_corpus(spark, manifest: DataFrame, sizes: DataFrame | None, questions: DataFrame, texts: DataFrame, pages: DataFrame, hosts: list[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """By name, each a DataFrame. ``pages`` is ``file, pages``; ``manifest`` may have ``pos``."""
    files = profile.corpus_files(manifest, sizes, hosts)
    rows = profile.question_rows(questions, manifest)
    named = files.join(manifest.select("rel", "pos"), "rel") if "pos" in manifest.columns else files.selectExpr("*", "rel AS pos")
    return {
        "files": files,
        "questions": rows,
        "kinds_by_domain": profile.kinds_by_domain(files),
        "keywords": profile.keyword_counts(named.where("kind = 'pdf'"), keyword_table(spark)),
        "difficulty_by_domain": profile.cross_tab(rows, "domain", "difficulty", ["easy", "medium", "hard"]),
        "question_lengths": profile.length_boxes(rows, "difficulty", "q_len"),
        "citation_mix": profile.citation_mix(rows),
        "domain_gaps": profile.domain_gaps(files, questions),
        "uncovered_domains": profile.uncovered_domains(files, questions),
        "missing_files": profile.missing_files(questions, files),
        "texts": profile.text_profile(texts),
        "pages": profile.page_profile(pages),
        "totals": profile.totals(files, rows),
    }

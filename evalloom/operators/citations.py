"""Citations: resolved against a page table and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import grade_of_score
from ..functions.text import MAX_CHARS, fill, normalise_path, shown_answer, source_blocks, strip, suffix
from ..functions.verdicts import grade
from ..sources.constants import ESTABLISHES, lookup
from ..sources.workspace import written
from .relational import narrowed

#: Pages of a file that stand for the whole of it.
FIRST_PAGES = 5


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def first_pages(pages: DataFrame, file: str = "file", page: str = "page", text: str = "text", pages_kept: int = FIRST_PAGES, size: int = MAX_CHARS) -> DataFrame:
    """``file, text, pages``: the first pages under their numbers, a mark if there are more, cut at ``size`` characters.

    The mark is cut like all else. One shuffle by file; what is collected for a file is ``pages_kept`` pages at most.
    """
    by = Window.partitionBy(file)
    placed = pages.withColumns({"_n": F.row_number().over(by.orderBy(page)), "_all": F.count("*").over(by)}).where(F.col("_n") <= pages_kept)
    part = F.struct("_n", F.concat(F.lit("[page "), F.col("_n").cast("string"), F.lit("]\n"), F.coalesce(F.col(text), F.lit(""))).alias("t"))
    joined = placed.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"), F.max("_all").alias("pages"))
    mark = F.concat(F.lit("\n\n[truncated: "), F.col("pages").cast("string"), F.lit(" pages total]"))
    whole = F.concat("text", F.when(F.col("pages") > pages_kept, mark).otherwise(""))
    return joined.select(file, F.substring(whole, 1, size).alias("text"), "pages")


def cited(answers: DataFrame) -> DataFrame:
    """A row for each citation, with its place; answers without any have none."""
    keys = [c for c in ("run_label", "id") if c in answers.columns]
    return answers.select(*keys, F.posexplode(F.coalesce("citations", F.array())).alias("cite_pos", "c")).select(*keys, "cite_pos", F.col("c.file").alias("raw_file"), F.col("c.page").alias("page"))


def resolve(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """``file, text, error, ok`` for each citation.

    A text file is one row without a page and ignores the cited page; a PDF has pages from 1 on, and without a page its first
    ones are taken. Errors, in this order: missing path, not found, empty text file, unreadable PDF (one row without page),
    PDF without pages (one row with page 0), page out of range, empty page, unsupported type. The page table is read once
    and narrowed to the files that are cited, without a shuffle; what is left is a table, joined by file and page, not collected.
    """
    c = citations.withColumn("file", F.coalesce(normalise_path(F.coalesce("raw_file", F.lit(""))), F.lit("")))
    # one pass over the page table, in which only what is cited is kept; all else is done on that
    pages = written(narrowed(pages.select("file", "page", "text"), "file", c.where("file <> ''").select("file").distinct()), "cited")
    files = pages.groupBy("file").agg(F.max("page").alias("last"), F.max(F.when(F.col("page").isNull(), F.col("text"))).alias("whole"))
    unpaged = c.where(F.col("page").isNull() & (suffix(F.col("file")) == ".pdf")).select("file").distinct()
    heads = first_pages(pages.where("page > 0").join(unpaged, "file", "left_semi")).select("file", F.col("text").alias("head"))
    single = pages.where("page IS NOT NULL")
    single = single.select(F.col("file").alias("_file"), F.col("page").alias("_page"), F.col("text").alias("one"))
    c = c.join(files.withColumn("known", F.lit(True)), "file", "left").join(heads, "file", "left")
    c = c.join(single, (F.col("file") == F.col("_file")) & (F.col("page") == F.col("_page")), "left")
    end = suffix(F.col("file"))
    error = (
        F.when(F.col("file") == "", "missing file path")
        .when(F.col("known").isNull(), F.concat(F.lit("file not found: "), "file"))
        .when((end == ".txt") & blank(F.col("whole")), "empty text file")
        .when(end == ".txt", None)
        .when((end == ".pdf") & F.col("last").isNull(), "unreadable PDF")
        .when((end == ".pdf") & (F.col("last") == 0), "PDF has no pages")
        .when((end == ".pdf") & F.col("page").isNull(), None)
        .when((end == ".pdf") & ((F.col("page") < 1) | (F.col("page") > F.col("last"))), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" out of range (1-"), F.col("last").cast("string"), F.lit(")")))
        .when((end == ".pdf") & blank(F.col("one")), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" is empty")))
        .when(end == ".pdf", None)
        .otherwise(F.concat(F.lit("unsupported file type: "), end))
    )
    text = F.when(end == ".txt", F.col("whole")).when(F.col("page").isNull(), F.col("head")).otherwise(F.col("one"))
    out = c.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.substring(text, 1, MAX_CHARS)))
    shown = F.when(F.col("error") == "missing file path", F.col("raw_file")).otherwise(F.col("file"))
    out = out.withColumn("file", shown).withColumn("ok", F.col("error").isNull() & ~blank(F.col("text")))
    return out.drop("raw_file", "known", "last", "whole", "head", "_file", "_page", "one")


def score(answers: DataFrame, resolved: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The score of each answer's citations.

    No citation scores 0 as ``not_at_all``; one that doesn't resolve makes it 0 whatever the others are; without a verdict
    the score is 0 and the grade null. ``details`` tell in order what became of each citation.
    """
    keys = [c for c in ("run_label", "id") if c in answers.columns]
    page = F.when(F.coalesce(F.col("page"), F.lit(0)) != 0, F.concat(F.lit(" p."), F.col("page").cast("string"))).otherwise("")
    said = F.when(F.col("ok"), F.concat(F.lit("resolved "), F.col("file"), page)).otherwise(F.concat(F.lit("invalid "), F.coalesce("file", F.lit("")), F.lit(": "), F.coalesce("error", F.lit("None"))))
    each = resolved.groupBy(*keys).agg(F.count_if("ok").cast("int").alias("n_ok"), F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("cite_pos", said.alias("d")))).alias("d"))
    out = answers.join(each, keys, "left")
    if verdicts is not None:
        out = out.join(verdicts.select(*keys, grade(F.col("establishes")).alias("_grade"), F.col("cost_usd").alias("citation_cost_usd")), keys, "left")
    else:
        out = out.withColumns({"_grade": F.lit(None).cast("string"), "citation_cost_usd": F.lit(None).cast("double")})
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("n_ok", F.lit(0))
    invalid = n - ok
    judged = (n > 0) & (invalid == 0)
    details = F.coalesce(F.transform("d", lambda x: x["d"]), F.array(F.lit("no citations provided")))
    return out.select(
        *answers.columns,
        F.coalesce(F.when(judged, lookup("_grade", ESTABLISHES, F.lit(0.0))), F.lit(0.0)).alias("citation_score"),
        F.when(judged, F.col("_grade")).otherwise("not_at_all").alias("citation_establishes"),
        ok.alias("citation_resolved"),
        n.alias("citation_total"),
        invalid.alias("citation_invalid"),
        F.concat(details, F.when(invalid > 0, F.array(F.lit("score=0 because at least one citation is invalid"))).when(judged & F.col("_grade").isNull(), F.array(F.lit("citation judge skipped"))).otherwise(F.array().cast("array<string>"))).alias("citation_details"),
        F.when(judged, F.coalesce("citation_cost_usd", F.lit(0.0))).otherwise(0.0).alias("citation_cost_usd"),
    )


def judge_requests(answers: DataFrame, resolved: DataFrame, template: str, **values: Column) -> DataFrame:
    """``id`` (and ``run_label``) and the ``prompt`` for each answer that the judge of citations is asked about: those
    with citations, all of which resolve. ``template`` has places for ``{answer}``, ``{sources}`` and the names of ``values``, columns of
    ``answers``. One row of the result holds what one answer cites."""
    keys = [c for c in ("run_label", "id") if c in answers.columns]
    shown = F.array_sort(F.collect_list(F.struct("cite_pos", F.struct("file", "page", "text").alias("s"))))
    valid = resolved.groupBy(*keys).agg(F.bool_and("ok").alias("_ok"), shown.alias("_s")).where("_ok")
    blocks = source_blocks(F.transform("_s", lambda x: x["s"]))
    return answers.join(valid, keys).select(*keys, fill(template, answer=shown_answer(F.col("answer")), sources=blocks, **values).alias("prompt"))


def options(questions: DataFrame, sources: str = "ground_truth_sources") -> DataFrame:
    """A row for each option of each group of expected sources."""
    groups = questions.select("id", F.posexplode(sources).alias("group_pos", "g"))
    return groups.select("id", "group_pos", F.posexplode("g.any_of").alias("opt_pos", "o")).select("id", "group_pos", "opt_pos", F.col("o.file").alias("file"), F.col("o.page").alias("page"))


def matches(option: Column, citation: Column) -> Column:
    """The same file, and the expected page null or the same."""
    return (normalise_path(option["file"]) == normalise_path(citation["file"])) & (option["page"].isNull() | F.coalesce(option["page"] == citation["page"], F.lit(False)))


def legacy_score(df: DataFrame, groups: str = "ground_truth_sources", citations: str = "citations") -> DataFrame:
    """The share of groups of which any option matches any citation; 1.0 without groups. ``legacy_invalid`` counts missed
    groups; ``legacy_details`` says for each group which option's file was met first, or what was expected. Both lists belong to
    one row and are short, so this is an expression and no join. Paths are normalised once each, and what was met is worked out
    once for all results: a generator of one row keeps the optimizer from writing it out for each of them."""
    named = lambda x: F.struct(x["file"].alias("raw"), normalise_path(x["file"]).alias("file"), x["page"].alias("page"))
    given = F.struct(F.transform(F.coalesce(groups, F.array()), lambda g: F.transform(g["any_of"], named)).alias("groups"), F.transform(F.coalesce(citations, F.array()), named).alias("cites"))
    same = lambda o, c: (o["file"] == c["file"]) & (o["page"].isNull() | F.coalesce(o["page"] == c["page"], F.lit(False)))
    first_met = lambda g, cites: F.filter(g, lambda o: F.exists(cites, lambda c: same(o, c)))
    met = lambda b: F.transform(b["groups"], lambda g: F.struct(F.try_element_at(first_met(g, b["cites"]), F.lit(1))["raw"].alias("m"), g.alias("g")))
    wanted = lambda g: F.concat(F.lit("["), F.array_join(F.transform(g, lambda o: F.concat(F.lit("'"), o["file"], F.lit("'"))), ", "), F.lit("]"))
    said = lambda z, i: F.concat(F.lit("group "), (i + 1).cast("string"), F.coalesce(F.concat(F.lit(": reference hit ("), z["m"], F.lit(")")), F.concat(F.lit(": reference miss (expected one of "), wanted(z["g"]), F.lit(")"))))

    def results(m: Column) -> Column:
        hits, total = F.size(F.filter(m, lambda z: z["m"].isNotNull())), F.size(m)
        score_ = F.when(total == 0, 1.0).otherwise(hits.cast("double") / total)
        told = F.when(total == 0, F.array(F.lit("no reference sources listed"))).otherwise(F.transform(m, said))
        return F.struct(score_.alias("legacy_score"), grade_of_score(score_).alias("legacy_establishes"), hits.alias("legacy_resolved"), total.alias("legacy_total"), (total - hits).alias("legacy_invalid"), told.alias("legacy_details"))

    bound = F.transform(F.transform(F.array(given), met), results)
    kept = [F.col(f"`{c}`") for c in df.columns if not c.startswith("legacy_")]
    return df.select(*kept, F.inline(bound))


def groups_satisfied(wanted: DataFrame, given: DataFrame, keys: list[str], group: str, on: Column) -> DataFrame:
    """J10 as a join, for groups too long for one row: per key the share of groups with any match, by equi-join and residual. Dealt
    by the keys once, for both aggregates."""
    hit = wanted.join(given, on, "left").repartition(*keys).groupBy(*keys, group).agg(F.bool_or(F.col("matched")).alias("hit"))
    return hit.groupBy(*keys).agg((F.count_if(F.coalesce("hit", F.lit(False))).cast("double") / F.count("*")).alias("score"), F.count("*").alias("groups"))


def in_manifest(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether each group of a question has an option that the manifest has (a question without groups does)."""
    known = manifest.select(F.col("rel").alias("file")).distinct().withColumn("known", F.lit(True))
    each = options(questions).join(known, "file", "left").groupBy("id", "group_pos").agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("any"))
    all_ = each.groupBy("id").agg(F.bool_and("any").alias("in_manifest"))
    return questions.join(all_, "id", "left").withColumn("in_manifest", F.coalesce("in_manifest", F.lit(True)))

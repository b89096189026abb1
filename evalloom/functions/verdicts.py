"""Judges' replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

GRADES = ("fully", "partially", "not_at_all")


def braces(c: Column) -> Column:
    """From the first opening brace to the last closing one; empty without."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often it is looked into."""
    return F.transform(F.array(value), body)[0]


def parse_object(c: Column) -> Column:
    """A variant from the whole text, else from the part in braces; null if neither is a JSON object."""
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    inner = _with(F.try_parse_json(braces(c)), lambda v: F.when(is_object(v), v))
    return _with(F.try_parse_json(strip(c)), lambda v: F.when(v.isNull(), inner).when(is_object(v), v))


def truthy(v: Column, field: str) -> Column:
    """A field as true or false by the rule that null, false, 0 and what is empty are false, all else is true."""

    def judge(x: Column) -> Column:
        text, kind = x["text"], x["kind"]
        return (
            F.when(text.isNull() | (kind == "VOID"), F.lit(False))
            .when(kind == "STRING", text != "")
            .when(kind == "BOOLEAN", text == "true")
            .when(kind.startswith("ARRAY"), text != "[]")
            .when(kind.startswith("OBJECT"), text != "{}")
            .otherwise(F.coalesce(x["number"] != 0, F.lit(True)))
        )

    get = lambda kind: F.try_variant_get(v, f"$.{field}", kind)
    return _with(F.struct(get("string").alias("text"), F.schema_of_variant(get("variant")).alias("kind"), get("double").alias("number")), judge)


def overridden(relevant: Column, hallucination: Column) -> Column:
    """What is invented isn't relevant."""
    return relevant & ~hallucination


def parse_verdict(raw: Column) -> Column:
    """A struct of ``relevant, hallucination, refusal, reasoning``, the override applied; null if the reply has no JSON object."""

    def fields(v: Column) -> Column:
        told = F.struct(*[truthy(v, f).alias(f) for f in ("relevant", "hallucination", "refusal")], F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")).alias("reasoning"))
        return F.when(v.isNotNull(), _with(told, lambda t: F.struct(overridden(t["relevant"], t["hallucination"]).alias("relevant"), t["hallucination"], t["refusal"], t["reasoning"])))

    return _with(parse_object(raw), fields)


def grade(c: Column) -> Column:
    """One of the three grades, in any case and with white space around; anything else is ``not_at_all``."""
    low = F.lower(strip(c))
    return F.when(low.isin(*GRADES), low).otherwise("not_at_all")


def parse_grade(raw: Column) -> Column:
    """A struct of ``establishes`` (one of the grades) and ``reasoning`` from a reply of the judge of citations; null without a JSON
    object, and what it doesn't tell is the least grade and no reasoning."""
    said = lambda v, f: F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit(""))
    return _with(parse_object(raw), lambda v: F.when(v.isNotNull(), F.struct(grade(said(v, "establishes")).alias("establishes"), said(v, "reasoning").alias("reasoning"))))


def in_range(confidence: Column) -> Column:
    """F16."""
    return confidence.isNull() | confidence.between(0.0, 1.0)

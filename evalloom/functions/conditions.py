"""Classes of rows and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.constants import DIFFICULTIES, PRICES


def ratio(a: Column, b: Column) -> Column:
    """0.0 where the divisor is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    """C34."""
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def grade_of_score(score: Column) -> Column:
    """C35."""
    return F.when(score == 1.0, "fully").when(score > 0, "partially").otherwise("not_at_all")


def outcome(relevant: Column, hallucination: Column, refusal: Column) -> Column:
    """One class a row; refusal comes before hallucination, hallucination before relevance."""
    return F.when(relevant.isNull(), "missing").when(refusal, "refusal").when(hallucination, "hallucination").when(relevant, "relevant").otherwise("wrong")


def primary_outcome(runs: Column) -> Column:
    """That of the first run."""
    r = F.try_element_at(runs, F.lit(1))
    return outcome(r["relevant"], r["hallucination"], r["refusal"])


def rate_class(rate: Column, good: bool) -> Column:
    """Rates of what is wanted are good from 0.5 on, rates of what isn't are bad from 0.3 on; null has no class."""
    return F.when(rate.isNull(), None).when(rate >= 0.5, "good").otherwise("bad") if good else F.when(rate.isNull(), None).when(rate >= 0.3, "bad").otherwise("good")


def card_class(out: Column) -> Column:
    """C40."""
    return F.when(out == "relevant", "ok").when(out.isin("hallucination", "wrong"), "fail").otherwise("")


def cell_class(value: Column) -> Column:
    """C41."""
    return F.when(value.isNull(), "dash").when(value >= 1, "yes").otherwise("no")


def percent(c: Column) -> Column:
    """P14."""
    return c * 100.0


def kilobytes(c: Column) -> Column:
    return c / F.lit(1024.0)


def megabytes(c: Column) -> Column:
    return c / F.lit(1024.0 * 1024.0)


def difficulty_rank(c: Column) -> Column:
    """0, 1, 2; -1 for anything else."""
    return F.coalesce((F.array_position(F.array(*[F.lit(d) for d in DIFFICULTIES]), c) - 1).cast("int"), F.lit(-1))


def token_sum(tokens: Column) -> Column:
    """Prompt and completion tokens, missing ones as 0."""
    return F.coalesce(tokens["prompt"], F.lit(0)) + F.coalesce(tokens["completion"], F.lit(0))


def token_cost(prompt: Column, completion: Column, prices: tuple[float, float] = PRICES) -> Column:
    """US dollars."""
    return (prompt.cast("double") * prices[0] + completion.cast("double") * prices[1]) / 1e6


def cycled(i: Column, n: int) -> Column:
    """W3."""
    return F.pmod(i, F.lit(n))

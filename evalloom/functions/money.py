"""Exact money: sums, means and shares as decimals, rounded half up once, at the end. What doesn't fit is an error, not null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of an amount before rounding, and of a sum.
DIGITS, SUM_DIGITS = 18, 28


def amount(value: Column | str, scale: int = 2) -> Column:
    """A number as an exact amount, rounded half up to ``scale`` digits by its shortest decimal form (0.145 is 0.15, as printed, though
    the binary number lies below). Null stays null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("string").cast(f"decimal(38,{scale + 12})"), scale).cast(f"decimal({DIGITS},{scale})")


def _checked(value: Column, kind: str, what: str) -> Column:
    narrow = value.try_cast(kind)
    return F.when(value.isNotNull() & narrow.isNull(), F.raise_error(F.lit(f"{what} has more digits than {kind}")).cast(kind)).otherwise(narrow)


def exact_sum(value: Column, scale: int = 2) -> Column:
    """Sum of amounts, the same whatever the order and partitions; null without any, an error beyond ``SUM_DIGITS``."""
    return _checked(F.sum(value.cast(f"decimal({SUM_DIGITS},{scale})")), f"decimal({SUM_DIGITS},{scale})", "a sum")


def exact_ratio(top: Column, bottom: Column, scale: int) -> Column:
    """``top`` / ``bottom``, both exact, rounded half up (away from zero) once to ``scale`` digits: whole units are divided, as a
    decimal quotient is rounded twice. Null where ``bottom`` is 0 or either is null."""
    up = F.lit(10**scale).cast("decimal(10,0)")
    num, den = F.abs(top).cast(f"decimal({SUM_DIGITS},2)"), F.abs(bottom).cast(f"decimal({SUM_DIGITS},2)")
    cents = lambda c: (c * 100).cast("decimal(30,0)")
    # floor((2 a 10^s + b) / 2 b) in whole numbers
    twice = (cents(num) * up * 2).cast("decimal(38,0)") + cents(den)
    whole = F.when(den != 0, F.call_function("div", twice, (cents(den) * 2).cast("decimal(38,0)")))
    sign = F.when((top < 0) != (bottom < 0), F.lit(-1)).otherwise(F.lit(1))
    return (whole * sign).cast("decimal(28,0)").cast(f"decimal(38,{scale})") / up

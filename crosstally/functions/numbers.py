"""Text-to-number coercion and number flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keys import strip


def no_nan(c: Column) -> Column:
    """NaN counts as missing; in Spark it would compare greater than every number."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a number becomes null.

    Java accepts a type suffix ('1d', '2f'), which is not a number here.
    """
    text = c.cast("string")
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), no_nan(text.try_cast("double")))


def number_from_thousands(c: Column) -> Column:
    return to_number(F.replace(c, F.lit(",")))


def money_digits(c: Column) -> Column:
    """Text without thousands commas, pound, dollar and euro signs and outer blanks."""
    return strip(F.regexp_replace(c, "[,£$€]", ""))


def number_from_money(c: Column) -> Column:
    return to_number(money_digits(c))


def threshold_flag(c: Column, at_least: float = 50) -> Column:
    """'Y' from the threshold upward, otherwise (missing included) 'N'."""
    return F.when(no_nan(c) >= at_least, "Y").otherwise("N")


def nulls_to_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clamp01(c: Column) -> Column:
    """Limit to 0..1; missing stays missing (``least`` and ``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))

"""Dates: tolerant parsing, version tags, page counts and the reporting calendar."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_date_or_null(c: Column, fmt: str | None = None) -> Column:
    """Timestamp (without zone) from text; a cell that does not parse becomes null."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz") if fmt else c.try_cast("timestamp_ntz")


def version_tag(ts: Column, major: str = "1.0") -> Column:
    """``1.0.<seconds since 1970>`` for a timestamp read as UTC."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.concat(F.lit(f"{major}."), seconds.cast("string"))


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def reporting_calendar(year: Column, quarter: Column) -> dict[str, Column]:
    """The 29 reporting-period attributes of a (year, quarter).

    Results come out one quarter late: the current quarter end is the quarter before the
    input; first-half results are out from Q3, second-half results from Q1 of the next year.
    The two half-year day counts are those of the two half-year periods named.
    """
    year, quarter = year.cast("int"), quarter.cast("int")

    def yy(y: Column) -> Column:
        return F.lpad((y % 100).cast("string"), 2, "0")

    index = year * 4 + quarter - 1

    def q_no(back: int) -> Column:
        return F.concat(F.lit("Q"), ((index - back) % 4 + 1).cast("string"))

    def q_year(back: int) -> Column:
        return F.floor((index - back) / 4).cast("int")

    def q_name(back: int) -> Column:
        return F.concat(q_no(back), yy(q_year(back)))

    def q_days(y: Column, q: int) -> Column:
        first = F.make_date(y, F.lit(3 * q - 2), F.lit(1))
        return F.datediff(F.add_months(first, 3), first).cast("bigint")

    def y_days(y: Column) -> Column:
        return F.datediff(F.make_date(y + 1, F.lit(1), F.lit(1)), F.make_date(y, F.lit(1), F.lit(1))).cast("bigint")

    half = F.when(quarter >= 3, 1).otherwise(2)
    half_year = F.when(quarter >= 3, year).otherwise(year - 1)

    def half_name(y: Column) -> Column:
        return F.concat(F.lit("H"), half.cast("string"), yy(y))

    def half_days(y: Column) -> Column:
        return F.when(half == 1, q_days(y, 1) + q_days(y, 2)).otherwise(q_days(y, 3) + q_days(y, 4))

    out = {
        "half_year_period": half_name(half_year),
        "prior_half_year_period": half_name(half_year - 1),
        "prior_year_end_period": F.concat(F.lit("FY"), yy(year - 1)),
        "current_quarter_end_period": q_name(1),
        "prior_quarter_end_period": q_name(2),
        "prior_quarter_end_period_previous_year": q_name(6),
        "total_days": y_days(year),
        "half_year_period_days": half_days(half_year),
        **{f"q{q}_days": q_days(year, q) for q in range(1, 5)},
        "previous_year_total_days": y_days(year - 1),
        "previous_year_half_year_period_days": half_days(half_year - 1),
        **{f"q{q}_days_previous_year": q_days(year - 1, q) for q in range(1, 5)},
        "half_year_end_results_period": F.concat(F.lit("H"), half.cast("string")),
        "quarter_end_results_period": q_no(1),
        "quarter_end_results_period_year": q_year(1).cast("string"),
        "prior_quarter_end_results_period": q_no(2),
        "prior_quarter_end_results_period_year": q_year(2).cast("string"),
        **{f"prior_{n}_quarter": q_name(2 + n) for n in range(1, 7)},
    }
    return out

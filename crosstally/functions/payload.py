"""Chart payloads: JSON extraction and repair, row cleaning with fixed or detected column types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keys import strip
from .numbers import money_digits, number_from_money

CHART_TYPE = "struct<header:array<string>,rows:array<array<string>>>"
PAYLOAD_TYPE = (
    f"struct<answer:string,chart_data:array<{CHART_TYPE}>,chart_type:string,"
    "chart_attributes:map<string,string>>"
)


def json_body(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, or null."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def repair_json(c: Column) -> Column:
    """Drop ``# …`` comments up to the line end and commas before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)\s*#.*$", ""), r",(\s*[}\]])", "$1")


def parse_payload(c: Column) -> Column:
    """Payload struct from a reply. As it stands if that parses, else repaired; a reply without
    JSON, or beyond repair, becomes the answer itself with no chart."""
    body = json_body(c)

    def parsed(text: Column) -> Column:
        return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, PAYLOAD_TYPE))

    plain = F.struct(
        strip(c).alias("answer"),
        F.array().cast(f"array<{CHART_TYPE}>").alias("chart_data"),
        F.lit(None).cast("string").alias("chart_type"),
        F.lit(None).cast("map<string,string>").alias("chart_attributes"),
    )
    return F.coalesce(parsed(body), parsed(repair_json(body)), plain)


def _usable(chart: Column) -> Column:
    return (F.size(chart["header"]) >= 2) & (F.size(chart["rows"]) > 0)


def _rebuilt(charts: Column, clean_rows) -> Column:
    done = F.transform(
        F.filter(charts, _usable),
        lambda ch: F.struct(ch["header"].alias("header"), clean_rows(ch).alias("rows")),
    )
    return F.coalesce(F.filter(done, lambda ch: F.size(ch["rows"]) > 0), F.array().cast(f"array<{CHART_TYPE}>"))


def clean_charts(charts: Column) -> Column:
    """Keep rows as wide as the header (2 or 3 columns used) whose last used cell is a number once
    commas and currency signs are gone; charts left without rows disappear. Numbers stay text in the
    payload type, in the digits given, ready to cast."""

    def rows(ch: Column) -> Column:
        used = F.least(F.size(ch["header"]), F.lit(3))
        fit = F.filter(ch["rows"], lambda r: F.size(r) == F.size(ch["header"]))
        last = lambda r: F.get(r, used - 1)
        good = F.filter(fit, lambda r: number_from_money(last(r)).isNotNull())
        return F.transform(good, lambda r: F.concat(F.slice(r, 1, used - 1), F.array(money_digits(last(r)))))

    return _rebuilt(charts, rows)


def clean_charts_typed(charts: Column) -> Column:
    """Detect number columns from the first row without missing cells, then convert them; a cell that
    does not convert stays text. Every chart is cleaned."""

    def looks_numeric(v: Column) -> Column:
        # Digits with at most one each of: point, minus, e, E.
        return F.translate(v, ".-eE", "").rlike("^[0-9]+$") & ~v.rlike(r"\..*\.|-.*-|e.*e|E.*E")

    def rows(ch: Column) -> Column:
        complete = F.filter(ch["rows"], lambda r: ~F.exists(r, lambda v: v.isNull()))
        numeric = F.transform(F.get(complete, F.lit(0)), looks_numeric)
        fit = F.filter(ch["rows"], lambda r: F.size(r) == F.size(ch["header"]))
        return F.transform(fit, lambda r: F.transform(r, lambda v, i: F.when(
            F.coalesce(F.get(numeric, i), F.lit(False)),
            F.when(number_from_money(v).isNotNull(), money_digits(v)).otherwise(v)).otherwise(v)))

    return _rebuilt(charts, rows)

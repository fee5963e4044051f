"""Predicates and filter stacks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from .joins import attach
from .ranking import top_per_key
from .schema import q

# Rating grades of the eligibility rules and the in-scope activity codes.
CONSUMER_GRADES = ("C1", "C2", "C3", "C4")
GOVERNANCE_GRADES = ("G1", "G2", "G3", "G4")
VIABILITY_GRADES = ("V1", "V2", "V3", "V4")


def all_of(predicates) -> Column:
    return reduce(and_, predicates, F.lit(True))


def contains_any(columns: list[Column], text: str) -> Column:
    """Case-insensitive literal substring in any of the columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in columns])


def matches_any(columns: list[Column], pattern: str) -> Column:
    """Case-insensitive regular expression in any of the columns; missing text does not match."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).rlike(pattern.lower()), F.lit(False)) for c in columns])


def facets(df: DataFrame, search: str | None = None, search_in: tuple[str, ...] = (), regex: bool = False,
           present: dict[str, bool | None] | None = None, **choices) -> DataFrame:
    """Apply only the filters that are set: text search, presence of a column, membership per column."""
    tests = []
    if search:
        tests.append((matches_any if regex else contains_any)([q(c) for c in search_in], search))
    for column, wanted in (present or {}).items():
        if wanted is not None:
            tests.append(q(column).isNotNull() if wanted else q(column).isNull())
    tests += [q(column).isin(*values) for column, values in choices.items() if values]
    return df.filter(all_of(tests))


def eligible_strict(registered: Column, status: Column, gov: Column, via: Column) -> Column:
    """Registered, active, governance and viability both in their two upper grades."""
    return registered & (status == "Active") & gov.isin(*GOVERNANCE_GRADES[:2]) & via.isin(*VIABILITY_GRADES[:2])


def eligible_broad(registered: Column, status: Column, con: Column, gov: Column, via: Column) -> Column:
    """Registered, active and holding any grade. A missing rating counts as not graded."""
    graded = [F.coalesce(c.isin(*g), F.lit(False)) for c, g in
              ((con, CONSUMER_GRADES), (gov, GOVERNANCE_GRADES), (via, VIABILITY_GRADES))]
    return registered & F.coalesce(status == "Active", F.lit(False)) & (graded[0] | graded[1] | graded[2])


def without_marker(df: DataFrame, columns: list[str], marker: str = "*") -> DataFrame:
    return df.filter(all_of([~F.coalesce(q(c).contains(marker), F.lit(False)) for c in columns if c in df.columns]))


def at_least(df: DataFrame, minimums: dict[str, float]) -> DataFrame:
    return df.filter(all_of([q(c) >= v for c, v in minimums.items()]))


def equal_to(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Equality filters from a dict; values are literals, so nothing needs escaping."""
    return df.filter(all_of([q(c) == F.lit(v) for c, v in values.items()]))


def where_metadata(df: DataFrame, equals: dict[str, object] | None = None,
                   any_of: dict[str, list] | None = None) -> DataFrame:
    """Equality on every entry of ``equals`` and membership for every entry of ``any_of``."""
    return df.filter(all_of([q(c) == F.lit(v) for c, v in (equals or {}).items()]
                            + [q(c).isin(*v) for c, v in (any_of or {}).items()]))


def in_runs(df: DataFrame, scenario: str, run_ids: list[str], most: int = 4) -> DataFrame:
    """Rows of a scenario and of 1 to ``most`` runs; both columns should be partition columns."""
    if not 1 <= len(run_ids) <= most:
        raise ValueError(f"give 1 to {most} run ids, not {len(run_ids)}")
    return df.filter((F.col("scenario") == scenario) & F.col("run_id").isin(*run_ids))


def in_recent_runs(df: DataFrame, runs: DataFrame, created: str, most: int = 4) -> DataFrame:
    """Rows of the ``most`` newest runs of every scenario in ``runs`` (``scenario, run_id`` and a creation time).

    If both are partition columns of ``df``, Spark reads the folders of these runs only: which ones they are is found
    out when the query runs and prunes the scan.
    """
    dated = runs.groupBy("scenario", "run_id").agg(F.max(q(created)).alias("__created"))
    recent = top_per_key(dated, ["scenario"], [F.desc_nulls_last("__created"), F.col("run_id")], most)
    return df.join(recent.select("scenario", "run_id"), ["scenario", "run_id"])


def rows_with_known_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return attach(df, keys.select(key).distinct(), key, how="left_semi")


def first_row(df: DataFrame, key: str, value, order: list[Column]) -> DataFrame:
    return df.filter(q(key) == F.lit(value)).orderBy(*order).limit(1)


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def any_element(array: Column, value) -> Column:
    return F.exists(array, lambda x: x == F.lit(value))


def not_deleted(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    return df.filter(~F.coalesce(q(flag), F.lit(False)))


def between_dates(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows with first <= date < last."""
    c = q(column)
    return df.filter((c >= F.lit(first).cast("timestamp_ntz")) & (c < F.lit(last).cast("timestamp_ntz")))

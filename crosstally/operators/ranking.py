"""Latest-per-key, first-per-key, top-n, paging and custom orders.

Top-k per key is a ``row_number`` filter: Spark then keeps at most k rows per key in every map
task (window group limit), so a hot key does not travel whole to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .schema import q


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in the given order; keep the rank under the name ``rank`` if wanted."""
    rn = rank or "__rn"
    ranked = df.withColumn(rn, F.row_number().over(Window.partitionBy(*[q(k) for k in keys]).orderBy(*order)))
    kept = ranked.filter(F.col(rn) <= n)
    return kept if rank else kept.drop(rn)


def latest_per_key(df: DataFrame, key: str, date: str, tiebreak: list[Column], nulls: str = "last") -> DataFrame:
    """Newest row per key. Rows without date come last, or first with ``nulls='first'``."""
    newest = q(date).desc_nulls_last() if nulls == "last" else q(date).desc_nulls_first()
    return top_per_key(df, [key], [newest, *tiebreak])


def first_per_subset(df: DataFrame, subset: list[str], order: list[Column]) -> DataFrame:
    """Drop duplicates on ``subset``, keeping the first row in the given order."""
    return top_per_key(df, subset, order)


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[q(c) for c in columns]).distinct()


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], number: int, size: int = 1000, deepest: int = 100_000) -> DataFrame:
    """Page ``number`` (from 1) of the ordered rows. All rows up to the page pass one task, so a page must end
    within the first ``deepest`` rows; further down use :func:`page_after`, which costs the same at any depth."""
    if number * size > deepest:
        raise ValueError(f"page {number} ends behind row {deepest}; use page_after")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last, size: int = 1000) -> DataFrame:
    """Next page after the key last seen: costs the same at any depth. ``key`` must be unique."""
    seen = df if last is None else df.filter(q(key) > F.lit(last))
    return seen.orderBy(q(key)).limit(size)


def page_total(df: DataFrame, size: int = 1000) -> DataFrame:
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("rows"), F.ceil(rows / F.lit(size)).cast("bigint").alias("pages"))


def order_by_labels(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Sort by the position of a label in a list; unlisted labels last."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), q(column))
    return df.orderBy(F.when(position == 0, len(labels) + 1).otherwise(position), q(column))


def sorted_pages(pages: Column) -> Column:
    """Page labels of an array in number order, those that are no number last."""
    keyed = F.transform(pages, lambda p: F.struct(
        F.coalesce(F.when(p.rlike("^[0-9]+$"), p).try_cast("bigint"), F.lit(2**63 - 1)).alias("n"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])

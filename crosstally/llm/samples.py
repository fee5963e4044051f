"""Bounded samples by hash, drawn without bringing a group together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def keys_by_hash(keys: DataFrame, limit: int, key: str = "key", within: str | None = None) -> DataFrame:
    """At most ``limit`` of the distinct keys (for each value of ``within``), those with the smallest hashes.

    A count says which hashes are small enough to leave about twice as many; only these are ranked, so what is
    ranked does not grow with the table. The draw is a function of the keys alone. Null keys are not drawn.
    """
    columns = [key, within] if within else [key]
    distinct = keys.select(*columns).dropna().distinct()
    share = F.pmod(F.xxhash64(key), F.lit(1 << 40)).cast("double") / float(1 << 40)
    if within:
        counts = distinct.groupBy(F.col(within).alias("__group")).agg(F.count("*").alias("__n"))
        counted = distinct.join(counts, F.col(within) == F.col("__group"))
    else:
        counted = distinct.withColumns({"__group": F.lit(0), "__n": distinct.agg(F.count("*")).scalar()})
    small = counted.filter(share * F.col("__n") <= 2 * limit + 50)
    rank = F.row_number().over(Window.partitionBy("__group").orderBy(F.xxhash64(key), key))
    return small.withColumn("__r", rank).filter(F.col("__r") <= limit).select(*columns)


def rows_of(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows with one of the keys. ``keys`` is a sample of a documented size, so its broadcast is bounded."""
    return df.join(F.broadcast(keys), list(on))

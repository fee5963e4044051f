"""Join shapes that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .schema import q


def fan_out_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join to a table with many rows per key; the right key column is dropped.

    Written as an inner join plus the left rows without partner: Spark splits a hot key on either
    side of an inner join and (see :func:`attach`) on the left of an anti join, but cannot split the
    right of a left join.
    """
    r = right.withColumnRenamed(right_key, "__key")
    matched = left.join(r, q(left_key) == F.col("__key"), "inner").drop("__key")
    lonely = attach(left, right.select(q(right_key)).distinct(), left_key, right_key, "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def attach(df: DataFrame, reduced: DataFrame, key: str, reduced_key: str | None = None, how: str = "left") -> DataFrame:
    """Join rows to a frame that was reduced to one row per key (an aggregate or distinct keys).

    Spark splits a hot key only if both sides of the join have an exchange of their own, and would otherwise
    reuse the partitioning of the reduction. Keys therefore compare null-safe, which asks for a new exchange;
    rows with a missing key still match nothing, as the reduced side drops its missing key.
    """
    r = reduced.filter(q(reduced_key or key).isNotNull()).withColumnRenamed(reduced_key or key, "__key")
    return df.join(r, q(key).eqNullSafe(F.col("__key")), how).drop("__key")


def join_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-group figures to every row of the group (keys compare null-safe).

    Used in place of a window over the group: the figures are pre-aggregated and a hot group of
    ``df`` can be split, while a window would put the whole group into one task.
    """
    if not keys:
        raise ValueError("give at least one key; use a scalar subquery for figures over all rows")
    t = totals.select(*[q(k).alias(f"__{k}") for k in keys], *[q(c) for c in totals.columns if c not in keys])
    test = [q(k).eqNullSafe(q(f"__{k}")) for k in keys]
    return df.join(t, test, "left").drop(*[f"__{k}" for k in keys])


def salted_totals(df: DataFrame, totals: DataFrame, keys: list[str], spread: Column, salts: int | None = None) -> DataFrame:
    """Inner form of :func:`join_totals` for use before another aggregation by the same keys.

    There Spark would reuse the join's partitioning, leave a hot group in one task and not split it.
    Here the group's rows are spread over ``salts`` partitions by the hash of ``spread`` and its one
    row of figures is repeated for each. Rows should differ in ``spread`` (count copies first). ``salts``
    is the number of shuffle partitions unless given.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    t = totals.select(*[q(k).alias(f"__{k}") for k in keys], *[q(c) for c in totals.columns if c not in keys],
                      F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__t"))
    test = [F.col("__s") == F.col("__t")] + [q(k).eqNullSafe(q(f"__{k}")) for k in keys]
    return df.withColumn("__s", salt).join(t, test).drop("__s", "__t", *[f"__{k}" for k in keys])


def figures(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates over all rows as one struct, read by a scalar subquery: one pass, one row, no join."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s")).scalar()

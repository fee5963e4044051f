"""Two-table reconciliation by bucket digests: only rows of buckets that differ are joined.

Rows fall into buckets by a hash of their key. A bucket's digest does not depend on the order of its rows: their
number, sums and exclusive ors of two row hashes. Equal digests on both sides mean equal rows, so such rows are
matches and are neither shuffled nor joined. Buckets that differ are cut finer and compared again; what still differs
is compared row by row. Two tables that differ in few rows thus shuffle little more than their digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import materialise
from .reconcile import reconcile_tables
from .schema import q

# Most buckets of each level: the lists of differing buckets, which are broadcast, have no more rows than these.
COARSE, FINE = 1 << 12, 1 << 8
LOW = (1 << 32) - 1


def row_hashes(key: str, values: list[str]) -> tuple[Column, Column]:
    """Two hashes of a row. Hash functions pass over nulls, so which values are null is hashed as well."""
    missing = F.array(*[q(v).isNull() for v in values])
    return F.xxhash64(q(key), missing, *map(q, values)), F.xxhash64(F.lit("second"), *map(q, reversed(values)), missing, q(key))


def with_buckets(df: DataFrame, key: str, coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """Adds ``__coarse`` and ``__fine`` (a number within the coarse bucket), null where the key is."""
    h = F.xxhash64(q(key))
    some = q(key).isNotNull()
    return df.withColumns({"__coarse": F.when(some, F.pmod(h, F.lit(coarse)).cast("int")), "__fine": F.when(some, F.pmod(F.shiftrightunsigned(h, 32), F.lit(fine)).cast("int"))})


def bucket_digests(df: DataFrame, by: list[str], key: str, values: list[str]) -> DataFrame:
    """``by``, ``n`` and ``digest`` per bucket; buckets are reduced in the map tasks."""
    first, second = row_hashes(key, values)
    rows = df.filter(F.col(by[0]).isNotNull()).select(*by, first.alias("f"), second.alias("s"))
    # Sums of half hashes: no overflow below two thousand million rows a bucket.
    sums = [F.sum(x) for c in ("f", "s") for x in (F.col(c).bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(c, 32))]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.struct(*sums, F.bit_xor("f"), F.bit_xor("s")).alias("digest"))


def differing_buckets(left: DataFrame, right: DataFrame, by: list[str], key: str, values: list[str]) -> DataFrame:
    """Buckets whose digests are not the same on both sides, or that one side lacks."""
    l, r = (bucket_digests(df, by, key, values).select(*by, F.struct("n", "digest").alias(name)) for df, name in ((left, "l"), (right, "r")))
    return l.join(r, by, "full_outer").filter(~F.col("l").eqNullSafe(F.col("r"))).select(*by)


def reconcile_by_digests(left: DataFrame, right: DataFrame, key: str, values: list[str], coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """The rows of :func:`reconcile.reconcile_tables`, for tables that are mostly equal.

    ``key`` is unique on either side; rows without key match nothing. Tables without rows are fine. The inputs are
    read three times, so they should be stored tables. The more rows differ, the more buckets are joined; where all
    of them do, this costs the plain join and two passes more. ``coarse * fine`` bounds what is broadcast.
    """
    l, r = (with_buckets(df.select(q(key), *map(q, values)), key, coarse, fine) for df in (left, right))
    first = materialise(differing_buckets(l, r, ["__coarse"], key, values), "differing-buckets")
    pick = lambda df, buckets, by, how: df.join(F.broadcast(buckets), by, how)
    both = ["__coarse", "__fine"]
    second = differing_buckets(pick(l, first, ["__coarse"], "left_semi"), pick(r, first, ["__coarse"], "left_semi"), both, key, values)
    second = materialise(second, "differing-fine-buckets")
    rows = [pick(df, second, both, "left_semi").unionByName(df.filter("__coarse is null")).drop(*both) for df in (l, r)]
    joined = reconcile_tables(*rows, key, values)
    equal = pick(l.filter("__coarse is not null"), second, both, "left_anti").select(
        q(key), *[q(v).alias(f"left_{v}") for v in values], *[q(v).alias(f"right_{v}") for v in values],
        F.lit("match").alias("outcome"), F.array().cast("array<string>").alias("differing"))
    return joined.unionByName(equal)


def report_by_digests(left: DataFrame, right: DataFrame, key: str, values: list[str], coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """``outcome, records`` of the same reconciliation."""
    return reconcile_by_digests(left, right, key, values, coarse, fine).groupBy("outcome").agg(F.count("*").alias("records"))

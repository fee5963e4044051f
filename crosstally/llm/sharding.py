"""Sharding by rendezvous hashing over weighted shards; DataFrame functions only.

Each (key, shard) pair has a hash of its own, read as a number u in (0, 1); the shard with the smallest
``-ln(u) / weight`` takes the key. A shard's share is its weight's share, and a further shard takes keys only
into itself, because no other pair's hash changes. Nothing but the key and the shards is looked at, so a row
finds its shard without a shuffle. Only the numbering inside shards needs one, of narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.sinks import materialise

# Fixed value: pieces into which a shard's rows are cut for numbering; 4,096 pieces of 40 shards number 3e10 rows
# with some 200,000 rows in each task's group.
PIECES = 4096
# Fixed value: equal rows that one count may stand for.
COPIES = 1 << 16


def cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, u from 53 bits of the hash of key and shard number. A weight of 0 takes no keys."""
    if weight < 0:
        raise ValueError("weights must not be negative")
    if weight == 0:
        return F.lit(float("inf"))
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a key: smallest cost, ties to the smaller number. Null keys are a key as well."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard must have a weight")
    pairs = [F.struct(cost(key, s, w).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return (F.least(*pairs) if len(pairs) > 1 else pairs[0])["s"]


def numbered(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Rows numbered from 0 without gaps inside each shard; ``order`` must tell all unlike rows of ``df`` apart.

    Rows equal in all columns are interchangeable: they are counted (within stretches of at most COPIES rows, so
    that no stretch grows with the table) and become rows again after their numbers are known. A row that is a
    third of the table is then as many counts as there are stretches. A shard holds a fixed share of all rows and
    would be too much for one task, so its counts are cut into pieces by the hash of the ``order`` columns; pieces
    are summed (partial aggregation), the sums are added up to each piece's first number, and the counts of a
    piece in that order.
    """
    keys = [F.col(f"`{c}`") for c in order]
    stretch = F.shiftright(F.monotonically_increasing_id(), COPIES.bit_length() - 1)
    counted = df.withColumn("__stretch", stretch).groupBy(*[F.col(f"`{c}`") for c in df.columns], "__stretch").agg(F.count("*").alias("__n"))
    # Written once: the sums and the numbering then read the same counts.
    counted = materialise(counted.withColumn("__piece", F.pmod(F.xxhash64(*keys), F.lit(PIECES)).cast("int")), "counted")
    sums = counted.groupBy(F.col(f"`{shard}`").alias("__shard"), F.col("__piece").alias("__p")).agg(F.sum("__n").alias("__sum"))
    up_to = Window.partitionBy("__shard").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # At most PIECES rows a shard, however many rows the shard has.
    first = sums.withColumn("__first", F.coalesce(F.sum("__sum").over(up_to), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(F.col(f"`{shard}`"), "__piece").orderBy(*keys, "__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    joined = ranked.join(first, (F.col(f"`{shard}`") == F.col("__shard")) & (F.col("__piece") == F.col("__p")))
    at = F.col("__first") + F.col("__before")
    return joined.withColumn(slot, F.explode(F.sequence(at, at + F.col("__n") - 1))).select(*[F.col(f"`{c}`") for c in df.columns], slot)


def shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    The shard depends on the key and the weights alone; ``grown_shard`` is the one with a further shard of the
    mean weight. Sizes are UTF-8 bytes of the text plus 16; a null text counts 0 bytes and has checksum 0, like
    an empty one. A null key is hashed as a key of its own. Repeated rows share a shard and get distinct slots;
    they may be any share of the table. No row gives none; further columns of ``docs`` are not looked at.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    further = sum(weights) / len(weights)
    k = F.col(f"`{key}`")
    placed = docs.select(
        k.alias("__key"), (F.octet_length(body) + 16).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(k, weights).alias("shard"), rendezvous(k, [*weights, further]).alias("grown_shard"))
    out = numbered(placed, "shard", ("__key", "text_crc32", "size"))
    return out.select(F.col("__key").alias(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """Write whole rows as Parquet, one folder per shard; adaptive rebalancing splits shards into files by size."""
    placed = docs.withColumn("shard", rendezvous(F.col(f"`{key}`"), weights))
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)

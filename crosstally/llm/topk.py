"""Exact top-k search by inner product with MaxScore.

A vector's components are the weights of its terms; a shard's posting list of a term holds that component of
all its vectors (zeros score nothing and may be there). Each shard knows, per term, the largest and smallest
weight and the largest remaining norm, which bound what a term, or all terms from some point on, can add to a
query's score. A query's terms are ordered by their bound. While the k best of the shard so far have a threshold
t, the terms from the end of that order whose joint bound does not reach t are non-essential: no vector gets into
the result by them alone. The essential postings are traversed for a whole block of vectors; a vector
stays competitive while its score so far plus the bound of what is left exceeds t, and only for competitive
vectors the non-essential postings are probed, piece by piece.

Queries and vectors are cut into blocks and every query block meets every shard once; each meeting returns k rows
a query, and these are merged. Scores are integers: sums are exact in double precision up to 2^53, and larger
ones are added as integers; the threshold is then lowered by what rounding may add, as only it is no integer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.sinks import materialise

# Vectors of a shard and of one traversal (a short one first, for a threshold), queries of a block, of one search and of
# one product, terms probed at a time. Shards and query blocks weigh alike: a vector is copied once a query block.
SHARD = 16384
FIRST, BLOCK = 256, 2048
QUERIES = 8192
TOGETHER = 256
ALIKE = 32
PROBE = 8


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double, as longs. Null for a null vector, one with null or
    non-finite components, and one with components beyond the range of a long."""
    def fine(x):
        y = x.cast("double") * scale
        return x.isNotNull() & ~F.isnan(y) & (F.abs(y) < 9.2e18)

    return F.when(F.coalesce(F.forall(vector, fine), F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


class Shard:
    """Vectors by ascending id; column j of ``vectors`` is the posting list of term j. With the terms' bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.high, self.low = self.vectors.max(axis=0).astype(float), self.vectors.min(axis=0).astype(float)
        self.norm = float(np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1).max()))


def bounds(queries: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """For each query its terms, the one with the highest bound first, and from each place on what all further
    terms together can add: the sum of their bounds, or the product of norms if that is smaller."""
    most = np.maximum(queries * shard.high, queries * shard.low)
    order = np.argsort(-most, axis=1, kind="stable")
    tail = lambda x: np.pad(np.cumsum(x[:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1)))
    summed = tail(np.take_along_axis(most, order, 1))
    norms = np.sqrt(tail(np.take_along_axis(queries, order, 1) ** 2)) * shard.norm
    both = np.minimum(summed, norms)
    return order, both + 1e-9 * np.abs(both)  # rounding must not make a bound too small


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query number: highest score, then smallest id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _traversed(weights: np.ndarray, essential: np.ndarray, block: np.ndarray) -> np.ndarray:
    """(queries, vectors of the block): sums over the essential postings, the only ones with a weight here."""
    score = np.zeros((len(weights), len(block)), weights.dtype)
    order = np.argsort(essential, kind="stable")
    order = order[essential[order] > 0]
    for at in range(0, len(order), ALIKE):
        own = order[at:at + ALIKE]
        used = np.flatnonzero((weights[own] != 0).any(axis=0))
        score[own] = weights[own][:, used] @ block[:, used].T
    return score


def search(query_ids: np.ndarray, queries: np.ndarray, shard: Shard, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score): each query's k best vectors of the shard, ties to smaller ids. Scores are
    Python integers where a long could not hold them."""
    largest = [max(int(np.abs(x).max(initial=0)), 1) for x in (queries, shard.vectors)]
    reach = largest[0] * largest[1] * max(queries.shape[1], 1)
    kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
    slack = 0.0 if kind is np.float64 else reach * 2.0 ** -50
    vectors, out = shard.vectors.astype(kind), ([], [], [])
    for lo in range(0, len(queries), TOGETHER):
        own, numbers = queries[lo:lo + TOGETHER].astype(kind), query_ids[lo:lo + TOGETHER]
        order, rest = bounds(queries[lo:lo + TOGETHER].astype(float), shard)
        ranked = np.take_along_axis(own, order, 1)
        terms = order.shape[1]
        threshold = np.full(len(own), -np.inf)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        at = 0
        while at < len(vectors):
            block, ids = vectors[at:at + (BLOCK if at else FIRST)], shard.ids[at:at + (BLOCK if at else FIRST)]
            at += len(block)
            # Non-essential: the terms behind the first place from which on all together stay below the threshold.
            essential = np.where((rest <= threshold[:, None]).any(axis=1), (rest <= threshold[:, None]).argmax(axis=1), terms)
            weights = np.zeros_like(own)
            np.put_along_axis(weights, order, np.where(np.arange(terms) < essential[:, None], ranked, 0), 1)
            score = _traversed(weights, essential, block)
            more = np.take_along_axis(rest, essential[:, None], 1)
            q, v = np.nonzero((score + more > threshold[:, None]) & (numbers[:, None] != ids[None, :]))
            score, done = score[q, v], essential[q]
            finished = []
            while len(q):
                ready = done >= terms
                finished.append((q[ready], ids[v[ready]], score[ready]))
                q, v, score, done = q[~ready], v[~ready], score[~ready], done[~ready]
                for _ in range(PROBE):
                    place = np.minimum(done, terms - 1)
                    score = score + np.where(done < terms, ranked[q, place] * block[v, order[q, place]], 0)
                    done = np.minimum(done + 1, terms)
                keep = score + rest[q, done] > threshold[q]
                q, v, score, done = q[keep], v[keep], score[keep], done[keep]
            held = tuple(np.concatenate(x) for x in zip(held, *finished))
            top = _best(*held, k)
            held = tuple(x[top] for x in held)
            # Later vectors have larger ids, so they need more than the k-th score.
            count = np.bincount(held[0], minlength=len(own))
            full = count >= k
            last = np.cumsum(count) - 1
            threshold[full] = held[2][last[full]].astype(float) - slack
        for o, x in zip(out, (numbers[held[0]], held[1], held[2])):
            o.append(x)
    kinds = np.int64, np.int64, object if kind is object else np.int64
    return tuple(np.concatenate(o).astype(t) if o else np.zeros(0, np.int64) for o, t in zip(out, kinds))


def top_k(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row that ``queries`` selects.

    A query is not its own candidate: rows with its id are left out. Of several vectors with a query's id the
    smallest asks. Vectors that are null or hold null or non-finite components take no part, nor do rows
    without id; vectors of different lengths are not compared. Repeated candidates count as often as they come,
    and are dealt to shards row by row, so that one id may be any share of the table. A score beyond the range
    of a long is ranked by its value (up to 2^126) and reported as the nearest long. An empty table gives no rows;
    further columns of ``rows`` are not looked at.
    """
    good = materialise(rows.withColumn("__q", F.coalesce(queries, F.lit(False))).select(F.col(f"`{key}`").cast("bigint").alias("id"), integers(F.col(f"`{vector}`")).alias("v"), "__q", F.monotonically_increasing_id().alias("place"))
                       .filter("id is not null and v is not null").withColumn("terms", F.size("v")), "integer-vectors")
    asked = materialise(good.filter("__q").groupBy("id", "terms").agg(F.min("v").alias("v")), "queries")
    sizes = good.groupBy("terms").agg(F.count("*").alias("n")).join(asked.groupBy("terms").agg(F.count("*").alias("m")), "terms")
    # A row per vector length: how many shards and query blocks it needs.
    sizes = materialise(sizes.select("terms", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("m") / QUERIES).cast("int").alias("blocks")), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    left = good.join(sizes, "terms").select("terms", dealt("shards", "id", "place").alias("shard"), every("blocks").alias("block"), "id", "v")
    right = asked.join(sizes, "terms").select("terms", dealt("blocks", "id").alias("block"), every("shards").alias("shard"), "id", "v")

    def meet(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = (np.zeros(0, np.int64),) * 3
        if len(vectors) and len(wanted):
            stacked = [np.stack(f.v.to_list()).reshape(len(f), -1).astype(np.int64) for f in (vectors, wanted)]
            found = search(wanted.id.to_numpy(), stacked[1], Shard(vectors.id.to_numpy(), stacked[0]), k)
        within = lambda x: np.clip(x, -1 << 63, (1 << 63) - 1).astype(np.int64)
        return pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": within(found[2]), "high": within(found[2] >> 62), "low": (found[2] & (1 << 62) - 1).astype(np.int64)})

    keys = ("terms", "shard", "block")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint, high bigint, low bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")

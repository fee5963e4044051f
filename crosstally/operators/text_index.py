"""Keyword search from an inverted index that Spark writes once and requests read in part.

The index is two Parquet tables and one row. ``postings``, partitioned by term bucket: for each term and block of
document ids the ids (as offsets in the block), term counts and document lengths, and as bounds the largest count and
the smallest length. ``terms``, partitioned alike: the number of documents with each term. ``corpus``: the number of
documents and their mean length. A request reads the buckets of its own terms; no text is taken apart again.

Requests are a table. Exact top-k goes in two passes: the blocks with the highest bounds give each request a score
to beat; only blocks whose bound reaches it are scored, each by itself: lists go to their block's requests, not scores of
single documents. A very frequent term is one row a block, not one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import terms
from ..sources.sinks import materialise
from .ranking import top_per_key
from .retrieval import BM25_B, BM25_K1, TEXT_HITS
from .schema import q

# Most documents of a block, and how many blocks each request starts with.
BLOCK, FIRST_BLOCKS = 4096, 2
# Requests that meet a block's lists at a time.
REQUESTS = 4096
# Given when read: an index without terms has no files.
POSTINGS = "term string, block bigint, docs array<smallint>, counts array<int>, lengths array<int>, most int, shortest int, bucket int"
TERMS = "term string, df bigint, bucket int"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(df: DataFrame, key: str, text: str, path: str, buckets: int = 256) -> None:
    """Indexes ``text`` of all rows under an integer ``key``. Keys are unique; rows without key are left out, rows
    without terms count as documents of length 0."""
    block = F.floor(F.col("doc") / BLOCK).cast("bigint")
    rows = df.filter(q(key).isNotNull()).select(q(key).cast("bigint").alias("doc"), q(text).alias("text"))
    # Texts are brought together by block, about one a partition; terms are counted and listed there.
    dealt = rows.withColumn("block", block).repartition(1 + rows.count() // BLOCK, "block").select("block", "doc", terms(F.col("text")).alias("t"))
    counted = dealt.select("block", "doc", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("block", "doc", "len", "term").agg(F.count("*").cast("int").alias("tf"))
    lists = counted.groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct((F.col("doc") - F.col("block") * BLOCK).cast("smallint").alias("doc"), "tf", "len"))).alias("p"))
    postings = lists.select(
        "term", "block", F.transform("p", lambda p: p.doc).alias("docs"), F.transform("p", lambda p: p.tf).alias("counts"), F.transform("p", lambda p: p.len).alias("lengths"),
        F.array_max(F.transform("p", lambda p: p.tf)).alias("most"), F.array_min(F.transform("p", lambda p: p.len)).alias("shortest"), bucket_of(F.col("term"), buckets).alias("bucket"))
    postings.repartition("bucket", F.pmod("block", F.lit(64))).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    written = df.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    held = written.groupBy("bucket", "term").agg(F.sum(F.size("docs")).alias("df"))
    held.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    total = written.agg(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)), F.lit(0)).alias("total"))
    n = rows.agg(F.count("*").alias("n"))
    n.select("n", total.scalar().alias("total"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/corpus")


def _part(tf: Column, length: Column, mean: float) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def asked_terms(spark: SparkSession, path: str, queries: DataFrame, query: str, text: str) -> tuple[DataFrame, DataFrame, float]:
    """``query, term, idf`` of the requests' known terms, the postings of the buckets they lie in, the mean length."""
    corpus = spark.read.parquet(f"{path}/corpus").first()
    wanted = queries.select(q(query).alias("query"), F.explode(F.array_distinct(terms(q(text)))).alias("term"))
    wanted = materialise(wanted.distinct().withColumn("bucket", bucket_of(F.col("term"), corpus.buckets)), "asked-terms")
    # At most as many numbers as there are buckets; as literals they are partition filters of the scans.
    read = sorted(r[0] for r in wanted.select("bucket").distinct().collect())
    known = spark.read.schema(TERMS).parquet(f"{path}/terms").filter(F.col("bucket").isin(read))
    idf = F.log(1.0 + (corpus.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = materialise(wanted.join(known, ["bucket", "term"]).select("query", "bucket", "term", idf.alias("idf")), "weighed-terms")
    return wanted, spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("bucket").isin(read)), max(corpus.total, 1) / max(corpus.n, 1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of scores that may be among the ``k`` best by nine decimals, ties in the given order: all that come
    close to the k-th, of equal ones the first ``k``."""
    order = np.argsort(-scores, kind="stable")
    ranked = scores[order]
    if len(ranked) <= k:
        return order
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    among = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    return order[(ranked >= ranked[k - 1] - 1e-8) & (among < k)]


def _scores(wanted: DataFrame, postings: DataFrame, blocks: DataFrame, mean: float, k: int) -> DataFrame:
    """``query, doc, score`` of the documents in the given blocks (``query, block``) of each request, of each block those
    that may be among the best ``k``."""
    def run(group: tuple, lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, list] = {}
        for term, docs, counts, lengths in zip(lists["term"], lists["docs"], lists["counts"], lists["lengths"]):
            held.setdefault(term, []).append((docs, _part(np.asarray(counts, float), np.asarray(lengths, float), mean)))
        out = [pd.DataFrame({"query": asked["query"].iloc[:0], "doc": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for name, mine in asked.groupby("query"):
            found = [(docs, idf * part) for term, idf in zip(mine["term"], mine["idf"]) for docs, part in held.get(term, ())]
            if found:
                at = np.concatenate([docs for docs, _ in found])
                total = np.bincount(at, np.concatenate([part for _, part in found]))
                hit = np.unique(at).astype(np.int64)
                hit = hit[_best(total[hit], k)]
                out.append(pd.DataFrame({"query": name, "doc": group[0] * BLOCK + hit, "score": total[hit]}))
        return pd.concat(out)

    parts = 1 + wanted.select("query").distinct().count() // REQUESTS
    asked = blocks.join(wanted, "query").select("query", "block", "term", "idf", F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part"))
    lists = postings.join(wanted.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").join(blocks.select("block").distinct(), "block", "left_semi")
    lists = lists.select("block", "term", "docs", "counts", "lengths", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    kind = wanted.schema["query"].dataType.simpleString()
    return lists.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(run, f"query {kind}, doc bigint, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = TEXT_HITS, query: str = "query", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Best ``k`` documents of each request by BM25: ``query, key, score, position``, scores compared to nine
    decimals, ties in key order. Requests of one name are one request; those without known terms have no hits."""
    wanted, postings, mean = asked_terms(spark, path, queries, query, text)
    bound = F.sum(F.col("idf") * _part(F.col("most"), F.col("shortest"), mean))
    bounds = materialise(postings.join(wanted, ["bucket", "term"]).groupBy("query", "block").agg(bound.alias("bound")), "block-bounds")
    order = [F.round("score", 9).desc(), F.col("doc")]
    first = top_per_key(bounds, ["query"], [F.desc("bound"), F.col("block")], FIRST_BLOCKS).select("query", "block")
    reached = top_per_key(_scores(wanted, postings, first, mean, k), ["query"], order, k, rank="position").filter(F.col("position") == k)
    reached = reached.select("query", F.col("score").alias("reached"))
    # A margin for sums that come in another order.
    open_ = bounds.join(reached, "query", "left").filter(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - 1e-6)).select("query", "block")
    open_ = materialise(open_, "open-blocks")
    hits = top_per_key(_scores(wanted, postings, open_, mean, k), ["query"], order, k, rank="position")
    return hits.select("query", F.col("doc").alias(key), "score", "position")

"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.sinks import materialise


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node with an edge; root is the smallest node of its component.

    Each round links every node's larger neighbours to its smallest neighbour, then every node and its
    smaller neighbours to the smallest of them, until the edges are stars. Rounds are written to the shared
    folder, so lineage stays short and a lost executor costs one round. Minima are partial aggregates; the
    join that attaches them can be split where a node has very many neighbours. Null ends are dropped.
    """
    now = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), "least").withColumnRenamed("u", "n")
        large = both.join(least, F.col("u") == F.col("n")).filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialise(large, "large-stars")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        small = materialise(small, "small-least").withColumnRenamed("u", "n")
        pairs = large.join(small, F.col("u") == F.col("n"))
        now = materialise(pairs.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*").filter("u > v").distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

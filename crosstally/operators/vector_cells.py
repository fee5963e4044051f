"""Exact nearest vectors from clustered cells with bounds.

Vectors, scaled to length 1, are written in cells around k-means centres, partitioned by cell; a cell keeps its centre,
its radius and its number of vectors. For a request q and any vector v of a cell with centre c and radius r the triangle
inequality gives |q - v| >= |q - c| - r, so the cosine is at most 1 - max(0, |q - c| - r)^2 / 2.

Requests are a table. Each one reads its best cells first, which gives it a score to beat, then only the cells whose
bound reaches it. A cell is dealt in pieces of a fixed size, so a cell of very many (or equal) vectors is many groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import materialise
from .ranking import top_per_key
from .retrieval import VECTOR_HITS
from .schema import q

# Centres are learned from about so many vectors, drawn by hash; all vectors are placed. Most cells there may be.
LEARNED, MOST_CELLS, PIECE, FIRST_CELLS = 50_000, 4096, 4096, 2
ROUNDS = 5


def unit(vector: Column) -> Column:
    """The vector at length 1; null if it is null, has no length or holds null, infinite or undefined components."""
    v = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((length > 0) & (length < float("inf")), F.transform(v, lambda x: x / length))


def write_cells(df: DataFrame, key: str, vector: str, path: str, cells: int = 256, piece: int = PIECE) -> None:
    """Writes ``path/vectors`` (``key``, the vector at length 1, partitioned by cell) and ``path/cells``. Rows without
    key and vectors that cannot be scaled are left out. All vectors are of one length of at least 1."""
    spark = df.sparkSession
    rows = materialise(df.select(q(key).cast("bigint").alias("key"), unit(q(vector)).alias("unit")).filter("key is not null and unit is not null"), "unit-vectors")
    n = rows.count()
    cells = max(2, min(cells, MOST_CELLS, n))
    share = int((1 << 40) * min(1.0, LEARNED / max(n, 1)))
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < share).select(array_to_vector("unit").alias("features"))
    centres = [c.tolist() for c in KMeans(k=cells, maxIter=ROUNDS, seed=7).fit(sample).clusterCenters()] if n and not sample.isEmpty() else []
    shared = spark.sparkContext.broadcast(np.array(centres))

    @F.pandas_udf("cell int, distance double")
    def place(units: pd.Series) -> pd.DataFrame:
        c, v = shared.value, np.array(units.tolist(), float)
        near = ((c * c).sum(axis=1) - 2 * v @ c.T).argmin(axis=1)
        return pd.DataFrame({"cell": near.astype(np.int32), "distance": np.sqrt(((v - c[near]) ** 2).sum(axis=1))})

    placed = materialise(rows.withColumn("p", place("unit")).select("key", "unit", "p.cell", "p.distance"), "placed-vectors")
    sizes = materialise(placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")), "cell-sizes")
    names = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    sizes.join(names, "cell").withColumn("pieces", F.ceil(F.col("n") / piece).cast("int")).coalesce(1).write.parquet(f"{path}/cells")
    # A cell is spread over tasks by size.
    placed.drop("distance").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")


def _scored(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """``query, key, score`` of all vectors in the cells of ``asked`` (``query, unit, cell, pieces``)."""
    def run(group: tuple, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(wanted):
            return pd.DataFrame({"query": [], "key": [], "score": []})
        v, out = np.array(held["unit"].tolist(), float), []
        for at in range(0, len(wanted), 256):
            some = wanted.iloc[at:at + 256]
            scores = np.array(some["unit"].tolist(), float) @ v.T
            out.append(pd.DataFrame({"query": np.repeat(some["query"].to_numpy(), len(v)), "key": np.tile(held["key"].to_numpy(), len(some)), "score": scores.ravel()}))
        return pd.concat(out)

    # Each piece of a cell meets the cell's requests.
    counts = asked.select("cell", "pieces").distinct()
    pieces = vectors.join(counts, "cell").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")).drop("pieces")
    wanted = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    kind = asked.schema["query"].dataType.simpleString()
    return pieces.groupBy("cell", "piece").cogroup(wanted.groupBy("cell", "piece")).applyInPandas(run, f"query {kind}, key bigint, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = VECTOR_HITS, query: str = "query", vector: str = "vector", key: str = "key") -> DataFrame:
    """Nearest ``k`` vectors of each request by cosine: ``query, key, score, position``, scores compared to nine
    decimals, ties in key order. Requests have unique names; those whose vector cannot be scaled have no hits."""
    # At most MOST_CELLS rows.
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    centres, radii = np.array([c.centre for c in cells]), np.array([c.radius for c in cells])
    numbers, pieces = np.array([c.cell for c in cells]), np.array([c.pieces for c in cells])
    shared = spark.sparkContext.broadcast((centres, radii, numbers, pieces))

    @F.pandas_udf("array<struct<cell:int,pieces:int,bound:double>>")
    def bounds(units: pd.Series) -> pd.Series:
        centres, radii, numbers, pieces = shared.value
        def of(v):
            if not len(numbers):
                return []
            # A margin for rounding.
            far = np.maximum(0, np.sqrt(((centres - np.asarray(v, float)) ** 2).sum(axis=1)) - radii - 1e-9)
            return [{"cell": int(c), "pieces": int(p), "bound": float(b)} for c, p, b in zip(numbers, pieces, 1 - far * far / 2)]
        return units.map(of)

    asked = queries.select(q(query).alias("query"), unit(q(vector)).alias("unit")).filter("unit is not null")
    asked = materialise(asked.withColumn("b", F.explode(bounds("unit"))).select("query", "unit", "b.*"), "cell-bounds")
    read = lambda frame: sorted(r[0] for r in frame.select("cell").distinct().collect())
    vectors = spark.read.schema("key bigint, unit array<double>, cell int").parquet(f"{path}/vectors")  # no cells, no files
    order = [F.round("score", 9).desc(), F.col("key")]
    first = materialise(top_per_key(asked, ["query"], [F.desc("bound"), F.col("cell")], FIRST_CELLS), "first-cells")
    reached = top_per_key(_scored(vectors.filter(F.col("cell").isin(read(first))), first), ["query"], order, k, rank="position")
    reached = reached.filter(F.col("position") == k).select("query", F.col("score").alias("reached"))
    open_ = asked.join(reached, "query", "left").filter(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - 1e-9)).drop("bound", "reached")
    open_ = materialise(open_, "open-cells")
    hits = top_per_key(_scored(vectors.filter(F.col("cell").isin(read(open_))), open_), ["query"], order, k, rank="position")
    return hits.select("query", F.col("key").alias(key), "score", "position")

"""Catalogue lookup by tokens: the files for a question, from a token table instead of a pass over the catalogue.

The words of a file's column names, path and scenario are taken apart once, when the table is written. It is partitioned
by token bucket; questions, which are a table, read the buckets of their own words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import materialise
from .catalogue import FILES_PER_QUESTION
from .ranking import top_per_key
from .schema import q

TOKENS = "token string, path string, places int, bucket int"


def tokens_of(c: Column) -> Column:
    """Distinct lower-cased words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_lookup(catalogue: DataFrame, columns: Column, path: str, buckets: int = 64) -> None:
    """Writes the token table of a catalogue with ``path`` and ``scenario``; ``columns`` is the array of column names.

    ``places`` counts in how many of the three a token stands. Paths are unique; rows without path are left out. A token
    of every path is spread over files by size.
    """
    parts = catalogue.filter("path is not null").select(
        "path", tokens_of(F.array_join(columns, " ")).alias("c"), tokens_of(F.col("path")).alias("p"), tokens_of(F.col("scenario")).alias("s"))
    rows = parts.select("path", "c", "p", "s", F.explode(F.array_union(F.array_union("c", "p"), "s")).alias("token"))
    places = sum((F.array_contains(a, F.col("token")).cast("int") for a in "cps"), F.lit(0))
    table = rows.select("token", "path", places.alias("places"), bucket_of(F.col("token"), buckets).alias("bucket"))
    table.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/tokens")
    catalogue.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def relevant_files(spark: SparkSession, path: str, questions: DataFrame, question: str = "question", text: str = "text", k: int = FILES_PER_QUESTION) -> DataFrame:
    """Best ``k`` files of each question: ``question, path, score, position``. A word counts once for each place it
    stands in; ties fall in path order; only files with a hit. Texts under one name are one question.

    Files that hold the same asked words in as many places score alike for every question, so the first ``k`` paths of
    each such group are enough; questions meet groups, not files.
    """
    buckets = spark.read.parquet(f"{path}/layout").first()[0]
    asked = questions.select(q(question).alias("question"), F.explode(tokens_of(q(text))).alias("token")).distinct()
    asked = materialise(asked.withColumn("bucket", bucket_of(F.col("token"), buckets)), "asked-tokens")
    # At most as many numbers as there are buckets; as literals they are partition filters of the scan.
    read = sorted(r[0] for r in asked.select("bucket").distinct().collect())
    table = spark.read.schema(TOKENS).parquet(f"{path}/tokens").filter(F.col("bucket").isin(read))
    held = table.join(asked.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi")
    files = held.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("token", "places"))).alias("found"))
    first = top_per_key(files, ["found"], [F.col("path")], k)
    scores = first.select("path", F.inline("found")).join(asked.select("question", "token"), "token").groupBy("question", "path").agg(F.sum("places").alias("score"))
    return top_per_key(scores, ["question"], [F.desc("score"), F.col("path")], k, rank="position").select("question", "path", "score", "position")

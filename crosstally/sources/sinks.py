"""Writers: exports, append-only logs, overwrites, partitioned layouts, row updates and deletes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import attach
from ..operators.schema import q


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, below the shared folder the session names in
    ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="crosstally-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several passes will read, and go on from the written table. Lost executors
    then cost a re-read, not a new computation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append records; the first append creates the table."""
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Truncate and load. ``df`` must not read from ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("cycle", "scenario", "run_id"), sep: str = "|") -> None:
    """Hive-style folders of delimited files.

    Rows are first brought together by folder so that a task does not open every folder; adaptive
    rebalancing then splits a large folder by size into several tasks and files.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).option("header", True).option("sep", sep).csv(path)


def partial_update(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows with the given new values; a missing new value keeps the old one. ``updates`` has one row per id."""
    changed = [c for c in updates.columns if c != key and c in table.columns]
    new = updates.select(q(key), *[q(c).alias(f"__new_{c}") for c in changed])
    joined = table.join(new, key, "left")
    return joined.select(*[
        (F.coalesce(q(f"__new_{c}"), q(c)).alias(c) if c in changed else q(c)) for c in table.columns])


def unknown_ids(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    return updates.select(key).join(table.select(key), key, "left_anti")


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return attach(table, ids.select(key).distinct(), key, how="left_anti")


def affected_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return attach(table, ids.select(key).distinct(), key, how="left_semi").agg(F.count(F.lit(1)).alias("affected"))

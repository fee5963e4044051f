"""A file catalogue that is kept up to date: only new or changed files are profiled again.

The catalogue is a log. Each refresh compares the listing (path, length, time) with what the log says, profiles
what differs, and appends a batch with the rows of these files and a mark for files that are gone. A batch without
a finished write does not exist, so a refresh that died is simply made again. The newest batch of a path counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import file_extension, separator_for
from ..operators.catalogue import _reason, catalogue_rows, halved, with_path_tags
from ..operators.file_profiles import PROFILE, delimited_profiles, file_key
from ..sources.bucketed import finished_versions
from ..sources.readers import list_files
from ..sources.sinks import materialise

# Suffixes of delimited text and of other formats, with Spark's name for each.
DELIMITED = (".csv", ".psv", ".pipe", ".tsv")
OTHERS = {".parquet": "parquet", ".json": "json", ".orc": "orc"}

LOG = "path string, length bigint, modified timestamp, gone boolean, column string, data_type string, sample_values array<string>, error string"


def _log(spark: SparkSession, store: str) -> DataFrame:
    """The newest batch's rows of every path."""
    done = finished_versions(spark, store)
    if not done:
        return spark.createDataFrame([], LOG).withColumn("version", F.lit(-1))
    rows = spark.read.option("basePath", store).schema(LOG).parquet(*[f"{store}/version={n}" for n in done])
    newest = rows.groupBy("path").agg(F.max("version").alias("version"))
    return rows.join(newest, ["path", "version"], "left_semi")


def current(spark: SparkSession, store: str) -> DataFrame:
    """The catalogue: path tags, name, type and a row per column; files that are broken or hold no value keep a row."""
    rows = _log(spark, store).filter("not gone").drop("gone", "version")
    return with_path_tags(rows, "path").withColumn("file_type", file_extension(F.col("path")))


def refresh(spark: SparkSession, root: str, store: str) -> int:
    """Brings the catalogue at ``store`` up to date with the files below ``root``; returns how many were profiled.

    Delimited files are profiled together, one pass for each separator; files of other formats are opened one
    by one, but only those that changed. Names of changed files pass through the driver, which lists them in
    any case. One refresh at a time.
    """
    listed = list_files(spark, root, [*DELIMITED, *OTHERS]).select(file_key(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))
    listed = materialise(listed, "listing")
    held = materialise(_log(spark, store).filter("not gone").select("path", "length", "modified").distinct(), "catalogued")
    changed = materialise(listed.join(held, ["path", "length", "modified"], "left_anti"), "changed-files")
    gone = held.select("path").join(listed.select("path"), "path", "left_anti")
    paths = [r["path"] for r in changed.select("path").orderBy("path").collect()]
    if not paths and gone.isEmpty():
        return 0
    parts, failed = [spark.createDataFrame([], PROFILE + ", error string")], {}
    plain = [p for p in paths if p.lower().endswith(DELIMITED)]
    for sep in sorted({separator_for(p) for p in plain}):
        own = [p for p in plain if separator_for(p) == sep]
        found, broken = halved(lambda some: materialise(delimited_profiles(spark, some, sep), "profiles"), own, _reason)
        parts += found
        failed |= broken
    formats = {p: fmt for p in paths for suffix, fmt in OTHERS.items() if p.lower().endswith(suffix)}
    if formats:
        parts.append(catalogue_rows(spark, formats).select("path", "column", "data_type", "sample_values", "error"))
    parts.append(spark.createDataFrame(list(failed.items()), "path string, error string"))
    profiles = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = changed.withColumn("gone", F.lit(False)).join(profiles, "path", "left")
    rows = rows.unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    version = max(finished_versions(spark, store), default=-1) + 1
    rows.write.mode("overwrite").parquet(f"{store}/version={version}")
    return len(paths)


def watch_once(files: DataFrame, root: str, store: str, checkpoint: str) -> None:
    """Refreshes the catalogue for the files that a stream of arrivals (``streams.arriving_files``) brings. A batch
    that is run again after a crash finds nothing left to do. A file that is overwritten in place is no arrival:
    the next arrival finds it, or a :func:`refresh` by itself."""
    query = files.writeStream.foreachBatch(lambda batch, number: refresh(batch.sparkSession, root, store)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

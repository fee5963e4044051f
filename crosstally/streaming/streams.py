"""Event streams: file arrivals, metric alarms, latest status, sessions, repeats.

Every function takes a batch or a streaming DataFrame and gives the same rows for both, except
that a stream holds back what its watermark has not closed. Rows later than the watermark
(10 minutes unless told otherwise) are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.paths import path_components_by_position

# Alarm period, breaching periods in a row, session gap in seconds;
# default columns and partitions of a catalogue row.
PERIOD_SECONDS, BREACHES, SESSION_GAP = 300, 2, 3600
DEFAULT_COLUMNS = ("period_id:string|business:string|segment_lob:string|level_2:string|level_3:string|"
                   "central_view:string|ccar_cluster:string|balance:double")
DEFAULT_PARTITIONS = "cycle,scenario,run_id"
LATENESS = "10 minutes"

ARRIVAL_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _timed(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Stream with one row per new file below a folder."""
    return (spark.readStream.format("binaryFile").schema(ARRIVAL_SCHEMA).option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(folder).drop("content"))


def arrival_catalogue(files: DataFrame, cycle: int = 4, scenario: int = 6, run: int = 7) -> DataFrame:
    """Catalogue row of every arrived file: tags by position in its path, default columns, creation time."""
    tags = path_components_by_position(F.col("path"), cycle, scenario, run)
    created = [F.col("modificationTime").alias("creation_date")] if "modificationTime" in files.columns else []
    rows = files.select(F.col("path"), *[c.alias(n) for n, c in tags.items()], *created,
                        F.lit(DEFAULT_COLUMNS).alias("columns"), F.lit(DEFAULT_PARTITIONS).alias("partitions"))
    return rows.withColumn("description", F.concat(
        F.lit("Balance sheet data for "), F.coalesce("scenario", F.lit("unknown")), F.lit(" scenario, "),
        F.coalesce("run_id", F.lit("unknown")), F.lit(", cycle "), F.coalesce("cycle", F.lit("unknown"))))


def period_figures(events: DataFrame, metric: str, value: str, ts: str = "ts", seconds: int = PERIOD_SECONDS,
                   lateness: str = LATENESS) -> DataFrame:
    """Sum, mean and number of values per metric and period."""
    return _timed(events, ts, lateness).groupBy(F.window(ts, f"{seconds} seconds"), metric).agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def alarms(events: DataFrame, metric: str, value: str, threshold: float, statistic: str = "total", ts: str = "ts",
           seconds: int = PERIOD_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Periods whose sum (``total``) or average (``mean``) exceeds the threshold."""
    return period_figures(events, metric, value, ts, seconds, lateness).filter(F.col(statistic) > threshold)


def sustained_alarms(events: DataFrame, metric: str, value: str, threshold: float, statistic: str = "total",
                     periods: int = BREACHES, ts: str = "ts", seconds: int = PERIOD_SECONDS,
                     lateness: str = LATENESS) -> DataFrame:
    """Periods ending a run of at least ``periods`` breaching periods.

    Breaching periods are counted in a sliding window as long as the run; the window is full exactly
    when all of them breach. No per-metric ordering is needed, and batch and stream share the plan.
    """
    breaching = alarms(events, metric, value, threshold, statistic, ts, seconds, lateness)
    at = breaching.select(metric, F.window_time("window").alias("at"))
    runs = at.groupBy(F.window("at", f"{seconds * periods} seconds", f"{seconds} seconds").alias("run"), metric).agg(
        F.count(F.lit(1)).alias("breaches"))
    return runs.filter(F.col("breaches") == periods).select(
        metric, (F.col("run.end") - F.expr(f"interval {seconds} seconds")).alias("period_start"))


def latest_status(log: DataFrame, keys: list[str], status: str, ts: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """Newest status per key (use update mode on a stream)."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return log.groupBy(*keys).agg(F.max_by(status, order).alias("status"), F.max(ts).alias("completed_at"),
                                  F.count(F.lit(1)).alias("changes"))


def sessions(events: DataFrame, user: str, ts: str = "ts", gap: int = SESSION_GAP, lateness: str = LATENESS) -> DataFrame:
    """Activity sessions ended by more than ``gap`` seconds of silence: ``session`` (start, end), user, events.

    Events of a user within one slot of ``gap`` seconds belong together, so a batch is first counted
    per user and slot in the map tasks; what is ordered per user is then as long as the calendar.
    """
    if events.isStreaming:
        return _timed(events, ts, lateness).groupBy(F.session_window(ts, f"{gap} seconds").alias("session"), user).agg(
            F.count(F.lit(1)).alias("events"))
    at = F.col(ts).cast("timestamp")
    slots = events.filter(at.isNotNull()).groupBy(user, F.floor(F.unix_micros(at) / (gap * 1_000_000)).alias("slot")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    pause = F.expr(f"interval {gap} seconds")
    by_time = Window.partitionBy(user).orderBy("slot")
    fresh = F.coalesce(F.col("first") > F.lag("last").over(by_time) + pause, F.lit(True))
    numbered = slots.withColumn("fresh", fresh.cast("int")).withColumn(
        "no", F.sum("fresh").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "no").agg(
        F.struct(F.min("first").alias("start"), (F.max("last") + pause).alias("end")).alias("session"), F.sum("n").alias("events")
    ).select("session", user, "events")


def without_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", keep_for: str = LATENESS) -> DataFrame:
    """Drop repeats of a key that arrive within the given time; for a batch, all repeats."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return _timed(stream, ts, keep_for).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into Parquet files and stop; a restart continues from the checkpoint."""
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())


def current_version(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The table that :func:`upsert_once` keeps: of every bucket its newest version (before a given one)."""
    every = spark.read.option("basePath", out).parquet(f"{out}/version=*")
    every = every if before is None else every.filter(F.col("version") < before)
    # A row for each bucket: few, whatever the table's size.
    newest = every.groupBy("bucket").agg(F.max("version").alias("version"))
    return every.join(newest, ["bucket", "version"], "left_semi")


def upsert_once(stream: DataFrame, keys: list[str], out: str, checkpoint: str, buckets: int = 16) -> None:
    """Keep the newest row per key of an update-mode stream, in buckets by the hash of the key.

    Each micro-batch writes a new version of the buckets it touches, from their last version and its
    changes; the other buckets stay. Of every bucket the two newest versions are kept, so a batch that is run
    again finds what it started from and writes the same version. Read with :func:`current_version`.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        versions = written_versions(spark, out)
        if any(v < number for v, _ in versions):
            touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most ``buckets``
            old = current_version(spark, out, number).filter(F.col("bucket").isin(*touched)).drop("version")
            batch = old.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
        batch.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/version={number}")
        drop_versions(spark, out)

    Path = stream.sparkSession._jvm.org.apache.hadoop.fs.Path

    def folders(spark: SparkSession, at: str, name: str) -> list[int]:
        path = Path(at)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return [int(n.removeprefix(name)) for n in names if n.startswith(name)]

    def written_versions(spark: SparkSession, at: str) -> list[tuple[int, int]]:
        return [(v, b) for v in folders(spark, at, "version=") for b in folders(spark, f"{at}/version={v}", "bucket=")]

    def drop_versions(spark: SparkSession, at: str) -> None:
        versions = written_versions(spark, at)
        for bucket in {b for _, b in versions}:
            for old in sorted(v for v, b in versions if b == bucket)[:-2]:
                path = Path(f"{at}/version={old}/bucket={bucket}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
     .trigger(availableNow=True).start().awaitTermination())

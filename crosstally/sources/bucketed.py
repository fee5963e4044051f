"""A table of rows by key in buckets, updated and deleted from by rewriting only the buckets that change.

Rows lie in folders by version and by the hash bucket of their key. A manifest, one small table for each version, says
for every bucket which version of it is current; it is written last, and a version without a finished manifest does
not exist. So a job that dies half-way leaves the table as it was, and readers see one version as a whole.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.schema import q
from .sinks import delete_ids, materialise, partial_update

BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def finished_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders ``version=N`` whose write was finished, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder)]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Versions with a finished manifest, oldest first."""
    return finished_versions(spark, f"{path}/manifests")


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Current version of every bucket; at most as many rows as there are buckets."""
    return dict(spark.read.parquet(f"{path}/manifests/version={version}").select("bucket", "current").collect())


def _write(spark: SparkSession, rows: DataFrame, key: str, path: str, version: int, buckets: int, before: dict[int, int], touched: list[int]) -> None:
    """A new version of the touched buckets, then its manifest. Files of a version that was never finished go."""
    data = rows.withColumn("bucket", bucket_of(q(key), buckets))
    data.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    now = before | dict.fromkeys(touched, version)
    lines = spark.createDataFrame([(b, v, buckets) for b, v in sorted(now.items())], "bucket int, current int, buckets int")
    lines.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/version={version}")


def create(df: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes a table under a path without one. Keys are unique; rows without key lie in a bucket of their own hash
    and can be neither updated nor deleted."""
    spark = df.sparkSession
    if _finished(spark, path):
        raise ValueError(f"there is a table at {path}")
    _write(spark, df, key, path, 0, buckets, {}, list(range(buckets)))


def current(spark: SparkSession, path: str, only: list[int] | None = None, version: int | None = None) -> DataFrame:
    """The rows of the newest (or a given) version, of all buckets or some. Versions are read while they are kept."""
    version = _finished(spark, path)[-1] if version is None else version
    held = _manifest(spark, path, version)
    wanted = {b: v for b, v in held.items() if only is None or b in only}
    every = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/version=*")
    # Literal partition filters: files of other versions are not opened.
    of_version: dict[int, list[int]] = {}
    for b, v in wanted.items():
        of_version.setdefault(v, []).append(b)
    pick = F.lit(False)
    for v, some in of_version.items():
        pick = pick | ((F.col("version") == v) & F.col("bucket").isin(some))
    return every.filter(pick).drop("bucket", "version")


def _changed(spark: SparkSession, path: str, ids: DataFrame, key: str) -> tuple[int, dict[int, int], int, list[int]]:
    """The newest version, its manifest, the number of buckets, and those with one of the ids."""
    version = _finished(spark, path)[-1]
    held = _manifest(spark, path, version)
    buckets = spark.read.parquet(f"{path}/manifests/version={version}").first()["buckets"]
    touched = sorted(r[0] for r in ids.filter(q(key).isNotNull()).select(bucket_of(q(key), buckets)).distinct().collect())
    return version, held, buckets, touched


def update(spark: SparkSession, path: str, updates: DataFrame, key: str) -> DataFrame:
    """Partial update by id (see :func:`sinks.partial_update`); returns the ids that no row has. Only buckets with
    one of the ids are read and written."""
    updates = materialise(updates, "updates")
    version, held, buckets, touched = _changed(spark, path, updates, key)
    old = current(spark, path, touched, version)
    unknown = materialise(updates.select(q(key)).join(old.select(q(key)), key, "left_anti"), "unknown-ids")
    if touched:
        _write(spark, partial_update(old, updates, key), key, path, version + 1, buckets, held, touched)
    return unknown


def delete(spark: SparkSession, path: str, ids: DataFrame, key: str) -> int:
    """Deletes rows by id; returns how many. Only buckets with one of the ids are read and written."""
    ids = materialise(ids.select(q(key)).distinct(), "deleted-ids")
    version, held, buckets, touched = _changed(spark, path, ids, key)
    old = current(spark, path, touched, version)
    n = old.join(ids, key, "left_semi").count()
    if n:
        _write(spark, delete_ids(old, ids, key), key, path, version + 1, buckets, held, touched)
    return n


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forgets all but the newest ``keep`` versions, and the files that none of these needs."""
    versions = _finished(spark, path)
    kept = {(v, b) for n in versions[-keep:] for b, v in _manifest(spark, path, n).items()}
    Path = spark._jvm.org.apache.hadoop.fs.Path
    files = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in versions[:-keep]:
        files.delete(Path(f"{path}/manifests/version={n}"), True)
    for folder in files.listStatus(Path(f"{path}/data")):
        v = int(folder.getPath().getName().removeprefix("version="))
        for part in files.listStatus(folder.getPath()) if v <= versions[-1] else ():
            name = part.getPath().getName()
            if name.startswith("bucket=") and (v, int(name.removeprefix("bucket="))) not in kept:
                files.delete(part.getPath(), True)

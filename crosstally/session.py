"""Session settings for the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: merge small partitions, split hot ones, pick broadcasts by measured size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where an aggregation behind it then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "crosstally", more: dict[str, str] | None = None) -> SparkSession.Builder:
    """A session builder with the settings above and ``more`` of them.

    Set ``spark.sql.shuffle.partitions`` to two or three times the cluster's cores (adaptive execution
    merges what is too many) and ``spark.checkpoint.dir`` to a folder all executors share.
    """
    b = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | (more or {})).items():
        b = b.config(k, v)
    return b

"""A key that holds a third of all rows is split: read from the final plans, broadcasts off."""

import pytest
from pyspark.sql import functions as F

from crosstally.operators import documents, filters, joins, reconcile
from crosstally.sources import sinks

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    left = spark.range(0, 9000, 1, 4).select(hot.alias("join_key"), "id", F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    right = spark.range(0, 3000, 1, 4).select(hot.alias("join_key"), (F.col("id") * 2).alias("other"))
    yield left, right
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


CASES = {
    "compare_rows": lambda l, r: reconcile.compare_rows(l, r),
    "overlap_rows": lambda l, r: reconcile.overlap_rows(l, r, ["join_key", "id", "pad"]),
    "only_left": lambda l, r: reconcile.only_left(l, r),
    "fan_out_join": lambda l, r: joins.fan_out_join(l, r.filter("other % 7 = 1 or join_key <> 'hot'"), "join_key", "join_key"),
    "rows_with_known_key": lambda l, r: filters.rows_with_known_key(l, r, "join_key"),
    "delete_ids": lambda l, r: sinks.delete_ids(l, r, "join_key"),
    "affected_rows": lambda l, r: sinks.affected_rows(l, r, "join_key"),
    "term_weights": lambda l, r: documents.term_weights(l.withColumn("text", F.concat_ws(" ", F.lit("hot"), "pad")), "id", "text"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_hot_key_is_split(skewed, name):
    df = CASES[name](*skewed)
    df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_missing_keys_match_nothing(spark):
    l = spark.createDataFrame([("a", 1), (None, 2)], "join_key string, id int")
    r = spark.createDataFrame([("a",), (None,)], "join_key string")
    assert [x.id for x in reconcile.only_left(l, r).collect()] == [2]
    assert [x.id for x in filters.rows_with_known_key(l, r, "join_key").collect()] == [1]
    assert sorted(x.id for x in joins.fan_out_join(l, r, "join_key", "join_key").collect()) == [1, 2]
    assert sorted((x.id, x.partners) for x in reconcile.compare_rows(l, r).collect() if x.id) == [(1, 1), (2, 0)]

"""Reconciliation by bucket digests."""

import random

import pytest
import pyspark.sql.functions as F

from crosstally.operators import digests
from crosstally.operators.reconcile import reconcile_tables

from .conftest import rows

SCHEMA = "id long, value double, label string, other string"


def tables(spark, n=3000, seed=1):
    rng = random.Random(seed)
    a, b = [], []
    for i in range(n):
        row = (i, rng.choice([None, 0.0, 1.5, float("nan")]), rng.choice([None, "x", "y"]), rng.choice([None, "x", "z"]))
        if rng.random() > 0.003:
            a.append(row)
        if rng.random() > 0.003:
            change = rng.random()
            # The last change moves a null between columns of one type.
            b.append(row if change > 0.01 else (i, 9.0, *row[2:]) if change > 0.004 else (*row[:2], row[3], row[2]))
    a += [(None, 1.0, "x", "x")] * 2
    b += [(None, 1.0, "x", "x"), (-1, -0.0, None, "x")]
    a += [(-1, 0.0, None, "x")]
    return spark.createDataFrame(a, SCHEMA).repartition(5), spark.createDataFrame(b, SCHEMA).repartition(3)


@pytest.mark.parametrize("coarse,fine", [(digests.COARSE, digests.FINE), (64, 16), (1, 1), (7, 1)])
def test_equals_the_plain_join(spark, coarse, fine):
    a, b = tables(spark)
    got = digests.reconcile_by_digests(a, b, "id", ["value", "label", "other"], coarse, fine)
    want = reconcile_tables(a, b, "id", ["value", "label", "other"])
    plain = lambda df: [repr(r).replace('-0.0', '0.0') for r in rows(df)]  # equal as numbers; a match shows the left one
    assert plain(got.select(*want.columns)) == plain(want)
    assert len({r[0] for r in rows(digests.report_by_digests(a, b, "id", ["value", "label", "other"], coarse, fine))}) == 4


def test_null_moved_to_another_column_changes_the_hash(spark):
    df = spark.createDataFrame([(1, 1.0, "x", None), (1, 1.0, None, "x"), (1, None, "1.0", "x")], SCHEMA)
    found = df.select(*[h.alias(n) for h, n in zip(digests.row_hashes("id", ["value", "label", "other"]), "ab")]).collect()
    assert len({r.a for r in found}) == len({r.b for r in found}) == 3


def test_digests_do_not_depend_on_order_but_on_repeats(spark):
    df = spark.createDataFrame([(i, float(i), "x", "y") for i in range(500)], SCHEMA)
    of = lambda d: rows(digests.bucket_digests(digests.with_buckets(d, "id", 8, 4), ["__coarse"], "id", ["value", "label", "other"]))
    assert of(df) == of(df.orderBy(F.desc("id")).repartition(7))
    assert of(df) != of(df.union(df.limit(2)))


def test_rows_of_equal_buckets_do_not_reach_the_join(spark):
    a = spark.range(20_000).select("id", F.col("id").cast("double").alias("value"), F.lit("x").alias("label"))
    b = a.withColumn("value", F.when(F.col("id") % 2000 == 0, -1.0).otherwise(F.col("value")))
    got = digests.reconcile_by_digests(a, b, "id", ["value", "label"])
    assert {r.outcome: r.records for r in got.groupBy("outcome").agg(F.count("*").alias("records")).collect()} == {"match": 19_990, "mismatch": 10}
    got.collect()
    exchanged = [n.metrics().get("shuffleRecordsWritten").get().value() for n in nodes(got._jdf.queryExecution().executedPlan()) if "ShuffleExchange" in n.getClass().getSimpleName()]
    assert exchanged and sum(exchanged) < 200


def nodes(plan):
    """All nodes of a final plan."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    for child in inner + [children.apply(i) for i in range(children.size())]:
        yield from nodes(child)
    yield plan


def test_empty_tables(spark):
    a, _ = tables(spark, 20)
    none = a.limit(0)
    values = ["value", "label", "other"]
    assert rows(digests.report_by_digests(none, none, "id", values)) == []
    assert rows(digests.report_by_digests(a, none, "id", values)) == [("missing_right", a.count())]
    assert rows(digests.report_by_digests(none, a, "id", values)) == [("missing_left", a.count())]

"""Token lookup, bucketed updates, pruned runs."""

import glob
import os
import random
import re

import pytest
import pyspark.sql.functions as F

from crosstally.operators import file_lookup
from crosstally.sources import bucketed
from crosstally.sources.sinks import scratch

from .conftest import rows


# --- lookup by tokens ---------------------------------------------------------------------------

def some_files(rng, n=300):
    words = ["total", "price", "Order", "key", "run001", "adverse", "été"]
    return [("/".join(["lake", *rng.choices(words, k=3), f"file_{i}.csv"]), rng.choice([None, "adverse", "severely_adverse"]), rng.choices(words, k=rng.randint(0, 3))) for i in range(n)] + [(None, "adverse", ["total"])]


def brute(files, text, k):
    words = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
    found = [(sum(len(words(text) & words(place)) for place in (p, s, " ".join(c))), p) for p, s, c in files if p is not None]
    return [(p, n) for n, p in sorted(((n, p) for n, p in found if n), key=lambda x: (-x[0], x[1]))[:k]]


def test_lookup_equals_pass_over_catalogue(spark):
    files, path = some_files(random.Random(2)), scratch(spark, "lookup")
    df = spark.createDataFrame(files, "path string, scenario string, columns array<string>")
    file_lookup.write_lookup(df, F.col("columns"), path, 8)
    asked = [("a", "Total PRICE of severely adverse orders"), ("b", "été"), ("none", "nothing here"), ("null", None), ("c", "file_17 csv csv")]
    got = {}
    for r in file_lookup.relevant_files(spark, path, spark.createDataFrame(asked, "question string, text string"), k=4).collect():
        got.setdefault(r.question, []).append((r.position, r.path, r.score))
    for name, text in asked:
        assert [(p, s) for _, p, s in sorted(got.get(name, []))] == brute(files, text, 4), name


def test_questions_meet_groups_of_files(spark):
    """Files that hold the same asked words are one group, of which no more than k go on."""
    path = scratch(spark, "lookup")
    df = spark.createDataFrame([(f"lake/orders_{i}.csv", None, ["total"]) for i in range(500)], "path string, scenario string, columns array<string>")
    file_lookup.write_lookup(df.repartition(4), F.col("columns"), path, 4)
    found = file_lookup.relevant_files(spark, path, spark.createDataFrame([(str(i), "total orders" if i % 2 else "lake") for i in range(20)], "question string, text string"), k=2)
    assert rows(found) == sorted(((str(i), f"lake/orders_{j}.csv", 2 if i % 2 else 1, p) for i in range(20) for p, j in ((1, 0), (2, 1))), key=repr)
    plan = found._jdf.queryExecution().toString()
    assert plan.count("Window") >= 2 and "collect_list" in plan


def test_lookup_reads_the_asked_buckets_only(spark):
    path = scratch(spark, "lookup")
    file_lookup.write_lookup(spark.createDataFrame(some_files(random.Random(3)), "path string, scenario string, columns array<string>"), F.col("columns"), path, 16)
    found = file_lookup.relevant_files(spark, path, spark.createDataFrame([("q", "total")], "question string, text string"))
    assert re.search(r"PartitionFilters: \[.*bucket", found._jdf.queryExecution().toString())
    empty = scratch(spark, "lookup")
    file_lookup.write_lookup(spark.createDataFrame([], "path string, scenario string, columns array<string>"), F.col("columns"), empty)
    assert file_lookup.relevant_files(spark, empty, spark.createDataFrame([("q", "total")], "question string, text string")).count() == 0


# --- buckets ------------------------------------------------------------------------------------

SCHEMA = "id long, name string, amount double"


def made(spark, n=200, buckets=8):
    path = scratch(spark, "bucketed")
    bucketed.create(spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(n)] + [(None, "no id", 0.0)], SCHEMA), "id", path, buckets)
    return path


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path.removeprefix('file://')}/data/*/*/*.parquet")}


def test_update_rewrites_touched_buckets_only(spark):
    path = made(spark)
    before = files_of(path)
    unknown = bucketed.update(spark, path, spark.createDataFrame([(3, "new", None), (5, None, -1.0), (999, "nobody", 1.0), (None, "null", 2.0)], SCHEMA), "id")
    assert rows(unknown) == [(999,), (None,)]
    got = {r.id: (r.name, r.amount) for r in bucketed.current(spark, path).collect()}
    assert len(got) == 201 and got[3] == ("new", 3.0) and got[5] == ("n5", -1.0) and got[7] == ("n7", 7.0) and got[None] == ("no id", 0.0)
    after = files_of(path)
    assert before.items() <= after.items()
    new = {re.search(r"bucket=(\d+)", f)[1] for f in set(after) - set(before)}
    assert 1 <= len(new) <= 3


def test_delete_and_versions(spark):
    path = made(spark)
    assert bucketed.delete(spark, path, spark.createDataFrame([(1,), (2,), (2,), (777,)], "id long"), "id") == 2
    assert bucketed.delete(spark, path, spark.createDataFrame([(777,)], "id long"), "id") == 0
    assert bucketed.current(spark, path).count() == 199 and bucketed.current(spark, path, version=0).count() == 201
    bucketed.update(spark, path, spark.createDataFrame([(9, "x", 9.5)], SCHEMA), "id")
    bucketed.drop_versions(spark, path, 1)
    got = {r.id: r.name for r in bucketed.current(spark, path).collect()}
    assert len(got) == 199 and got[9] == "x" and 1 not in got


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, monkeypatch):
    path = made(spark)
    want = rows(bucketed.current(spark, path))
    change = spark.createDataFrame([(3, "new", None)], SCHEMA)
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: (_ for _ in ()).throw(RuntimeError("lost")) if "current" in str(schema) else real(data, schema, **k))
    with pytest.raises(RuntimeError):
        bucketed.update(spark, path, change, "id")
    monkeypatch.undo()
    assert len(files_of(path)) > 8 and rows(bucketed.current(spark, path)) == want
    # The next writer starts from the old version and takes the unfinished one's place.
    bucketed.update(spark, path, change, "id")
    assert {r.id: r.name for r in bucketed.current(spark, path).collect()}[3] == "new"


def test_buckets_of_an_empty_table(spark):
    path = scratch(spark, "bucketed")
    bucketed.create(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), "id", path, 4)
    with pytest.raises(ValueError):
        bucketed.create(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), "id", path, 4)
    assert bucketed.delete(spark, path, spark.createDataFrame([(1,)], "id long"), "id") == 1
    assert bucketed.current(spark, path).count() == 0
    assert bucketed.update(spark, path, spark.createDataFrame([], SCHEMA), "id").count() == 0


# --- runs ---------------------------------------------------------------------------------------

def test_recent_runs_prune_the_folders(spark):
    from crosstally.operators.filters import in_recent_runs
    path = scratch(spark, "runs")
    data = [(s, f"run{r:03}", float(r)) for s in ("base", "adverse") for r in range(12)]
    spark.createDataFrame(data, "scenario string, run_id string, amount double").write.partitionBy("scenario", "run_id").parquet(f"{path}/data")
    spark.createDataFrame([(s, f"run{r:03}", r) for s in ("base", "adverse") for r in range(12)], "scenario string, run_id string, created int").write.parquet(f"{path}/catalogue")
    got = in_recent_runs(spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/catalogue").filter("scenario = 'base'"), "created", 4)
    assert rows(got.select("scenario", "run_id")) == [("base", f"run{r:03}") for r in range(8, 12)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan

import os

import pytest
from pyspark.sql import functions as F

from crosstally.operators import catalogue, file_profiles
from crosstally.sources import readers
from crosstally.streaming import catalogue_feed as feed, streams


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def plain(rows):
    """Rows by path without scheme: (path, column, type, samples, broken)."""
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    return sorted(((r[0], r[1], r[2], r[3], r[4]) for r in rows.select(path, "column", "data_type", "sample_values", F.col("error").isNotNull()).collect()), key=repr)


def full(spark, root):
    found = readers.list_files(spark, root, [*feed.DELIMITED, *feed.OTHERS]).collect()
    kind = lambda p: "csv" if p.endswith(feed.DELIMITED) else "parquet"
    return plain(catalogue.catalogue_rows(spark, {r.path: kind(r.path) for r in found}))


@pytest.fixture
def lake(tmp_path):
    root = str(tmp_path / "lake")
    put(f"{root}/cycle7/run001", "a.csv", "id,name,amount\n3,x,1.5\n1,\"y, z\",2\n20,,-4e2\n")
    put(f"{root}/cycle7/run001", "b.psv", "key|when|a, b\n5|2024-01-02|u\n4|2024-01-01|v\n")
    put(f"{root}/cycle7/run002", "c c.tsv", "n\tm\n" + "".join(f"{i}\tt{i}\n" for i in range(40)))
    return root, str(tmp_path / "store"), str(tmp_path / "checkpoint")


def test_only_new_or_changed_files_are_profiled(spark, lake):
    root, store, _ = lake
    assert feed.refresh(spark, root, store) == 3 and plain(feed.current(spark, store)) == full(spark, root)
    assert feed.refresh(spark, root, store) == 0
    put(f"{root}/cycle7/run001", "a.csv", "id,other\n1,x\nq,y\n")
    put(f"{root}/cycle7/run003", "broken.parquet", "no parquet")
    assert feed.refresh(spark, root, store) == 2 and plain(feed.current(spark, store)) == full(spark, root)
    spark.range(3).coalesce(1).write.parquet(f"{root}/cycle8/d")
    os.remove(f"{root}/cycle7/run001/b.psv")
    assert feed.refresh(spark, root, store) == 1 and plain(feed.current(spark, store)) == full(spark, root)
    tags = feed.current(spark, store).filter("file_name = 'broken.parquet'").select("cycle", "run_id", "file_type", "column").collect()
    assert [tuple(r) for r in tags] == [("cycle7", "run003", "parquet", None)]


def test_stream_of_arrivals_restarts_and_ignores_unfinished_batches(spark, lake):
    root, store, checkpoint = lake
    arrivals = lambda: streams.arriving_files(spark, root)
    feed.watch_once(arrivals(), root, store, checkpoint)
    assert plain(feed.current(spark, store)) == full(spark, root)
    os.makedirs(f"{store}/version=1")  # a batch that died
    put(f"{root}/cycle7/run002", "e.csv", "p\n1\n1.5\n")
    feed.watch_once(arrivals(), root, store, checkpoint)
    assert plain(feed.current(spark, store)) == full(spark, root)
    assert feed.finished_versions(spark, store) == [0, 1]


def test_parts_of_a_file_merge(spark, tmp_path):
    """Numbers, then a decimal, then a text: the type is that of all values, wherever a part ends."""
    put(str(tmp_path), "x.csv", "i,f,s,none\n" + "".join(f"{i},{i if i < 900 else i + .5},{i if i < 990 else 'z'},\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {r.column: (r.data_type, r.sample_values) for r in file_profiles.delimited_profiles(spark, [str(tmp_path / "x.csv")], ",").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    texts = sorted([str(i) for i in range(990)] + ["z"])[:10]
    assert got == {"i": ("int", list("01234")), "f": ("float", [f"{i}.0" for i in range(5)]), "s": ("string", texts)}


def test_broken_items_are_found_by_halves(spark):
    calls = []

    def profile(items):
        calls.append(items)
        if 37 in items:
            raise ValueError("37 is broken")
        return spark.createDataFrame([(i,) for i in items], "i int")

    found, failed = catalogue.halved(profile, range(64), str)
    assert failed == {37: "37 is broken"} and sorted(r.i for f in found for r in f.collect()) == [i for i in range(64) if i != 37]
    assert len(calls) <= 13 and catalogue.halved(profile, [], str) == ([], {})

"""Readers and writers over temporary folders; streams run to completion and compared with the batch."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crosstally.sources import readers, sinks
from crosstally.streaming import streams
from tests.conftest import rows


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_separator_by_suffix(spark, tmp_path):
    for name, sep in (("a.csv", ","), ("b.psv", "|"), ("c.pipe", "|"), ("d.tsv", "\t")):
        p = write(tmp_path / name, f"id{sep}name\n1{sep}x\n")
        assert rows(readers.read_csv(spark, p)) == [(1, "x")]


def test_bad_cells(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.DoubleType())])
    p = write(tmp_path / "a.csv", "id,v\n1,2.5\nx,3\n2,n/a\n")
    assert rows(readers.read_csv(spark, p, schema, tolerant=True)) == sorted([(1, 2.5), (None, 3.0), (2, None)], key=repr)
    kept = {r["_corrupt_record"] for r in readers.read_corrupt_aware(spark, p, schema).collect()}
    assert kept == {None, "x,3", "2,n/a"}
    with pytest.raises(Exception):
        readers.read_csv(spark, p, schema).collect()


def test_json_lines_and_array(spark, tmp_path):
    data = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    lines = write(tmp_path / "l.json", "\n".join(json.dumps(d) for d in data))
    array = write(tmp_path / "a.json", "\n  " + json.dumps(data, indent=1))
    assert not readers.is_json_array(spark, lines) and readers.is_json_array(spark, array)
    for p in (lines, array):
        assert rows(readers.read_json(spark, p, "a int, b string")) == [(1, "x"), (2, "y")]


def test_multiline_cells_and_byte_order_mark(spark, tmp_path):
    p = write(tmp_path / "q.csv", '﻿Question ID,Question,Context\nQ1,"two\nlines","a ""quoted"" word"\n')
    got = readers.read_multiline_csv(spark, p, "`Question ID` string, Question string, Context string")
    assert rows(got) == [("Q1", "two\nlines", 'a "quoted" word')]


def test_latin1(spark, tmp_path):
    p = write(tmp_path / "l.csv", "id,name\n1 , Société \n", "latin-1")
    assert rows(readers.read_trimmed(spark, p, "id string, name string")) == [("1", "Société")]


def test_preamble_in_every_file(spark, tmp_path):
    for n in range(3):
        body = "".join(f"{n},row {i}\n" for i in range(50))
        write(tmp_path / f"f{n}.csv", f"Published list\nas of today\nfile no,The label\n{body}")
    got = readers.read_after_preamble(spark, str(tmp_path), 2)
    assert got.columns == ["file no", "The label"]
    assert rows(got.groupBy("file no").count()) == [("0", 50), ("1", 50), ("2", 50)]
    # Small splits: lines of later splits must all survive.
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        assert readers.read_after_preamble(spark, str(tmp_path), 2).count() == 150
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_partitioned_layout_prunes(spark, tmp_path):
    d = spark.createDataFrame([(i, float(i), "c1", "adverse" if i % 2 else "baseline", f"run{i % 3}") for i in range(30)],
                              "id int, v double, cycle string, scenario string, run_id string")
    out = str(tmp_path / "t")
    sinks.write_partitioned(d, out)
    back = readers.read_partitioned(spark, out, "id int, v double")
    picked = back.filter((F.col("scenario") == "adverse") & F.col("run_id").isin("run1"))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan
    assert back.count() == 30 and rows(picked.select("id")) == sorted([(i,) for i in range(30) if i % 2 and i % 3 == 1], key=repr)


def test_load_all_fails_if_incomplete(spark, tmp_path):
    p = write(tmp_path / "a.csv", "id\n1\n")
    with pytest.raises(ValueError, match="name"):
        readers.load_all(spark, {"a": ("csv", p, ["id", "name"])})
    with pytest.raises(Exception):
        readers.load_all(spark, {"a": ("csv", str(tmp_path / "none.csv"), ["id"])})


def test_update_and_delete(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, n string, v double")
    u = spark.createDataFrame([(1, None, 9.0), (3, "z", 3.0)], "id int, n string, v double")
    assert rows(sinks.partial_update(t, u, "id")) == [(1, "a", 9.0), (2, "b", 2.0)]
    assert rows(sinks.unknown_ids(t, u, "id")) == [(3,)]
    assert rows(sinks.delete_ids(t, u, "id")) == [(2, "b", 2.0)]
    assert rows(sinks.affected_rows(t, u, "id")) == [(1,)]


def test_scratch_uses_the_shared_folder(spark):
    assert sinks.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# --- streams ------------------------------------------------------------------------------------

SCHEMA = "id bigint, ts timestamp_ntz, metric string, value double"
T0 = dt.datetime(2024, 1, 1)


def events(spark, data):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), m, v) for i, (s, m, v) in enumerate(data)], SCHEMA)


def stream_of(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


CLOSER = [(999999, "z", 0.0)]


def test_alarms_stream_equals_batch(spark, tmp_path):
    data = [(s, "m" if s % 7 else "n", float(s % 11)) for s in range(0, 6000, 40)]
    d, path = events(spark, data), str(tmp_path / "in")
    land(d, path)
    land(events(spark, CLOSER), path)
    streams.run_once(streams.alarms(stream_of(spark, path), "metric", "value", 30.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    keep = lambda x: rows(x.select(F.col("window.start").cast("timestamp_ntz"), "metric", "total", "n"))
    assert keep(spark.read.parquet(str(tmp_path / "out"))) == keep(streams.alarms(d, "metric", "value", 30.0)) != []


def test_late_rows_are_dropped_and_restart_continues(spark, tmp_path):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    run = lambda: streams.run_once(streams.alarms(stream_of(spark, path), "metric", "value", 0.0), out, cp)
    land(events(spark, [(10, "m", 1.0), (2000, "m", 1.0)]), path)
    run()
    land(events(spark, [(20, "m", 50.0)]), path)  # older than the watermark (2000 s less 10 minutes)
    land(events(spark, CLOSER), path)
    run()
    got = rows(spark.read.parquet(out).filter("metric = 'm'").select("total", "n"))
    assert got == [(1.0, 1), (1.0, 1)]


def test_sustained_alarms(spark, tmp_path):
    # Periods 0, 1, 2 and 5 breach for m; 1 and 3 for n.
    data = [(300 * p + 5, "m", 10.0) for p in (0, 1, 2, 5)] + [(300 * 3, "m", 1.0)] + [(300 * p + 9, "n", 10.0) for p in (1, 3)]
    d, path = events(spark, data), str(tmp_path / "in")
    want = [("m", T0 + dt.timedelta(seconds=300 * p)) for p in (1, 2)]
    tidy = lambda x: rows(x.select("metric", F.col("period_start").cast("timestamp_ntz")))
    assert tidy(streams.sustained_alarms(d, "metric", "value", 5.0)) == sorted(want, key=repr)
    assert tidy(streams.sustained_alarms(d, "metric", "value", 5.0, periods=3)) == sorted(want[1:], key=repr)
    land(d, path)
    land(events(spark, CLOSER), path)
    streams.run_once(streams.sustained_alarms(stream_of(spark, path), "metric", "value", 5.0), str(tmp_path / "o"), str(tmp_path / "c"))
    assert tidy(spark.read.parquet(str(tmp_path / "o"))) == sorted(want, key=repr)


def test_sessions(spark, tmp_path):
    data = [(0, "u", 1.0), (3599, "u", 1.0), (7198, "u", 1.0), (7198 + 3601, "u", 1.0), (50, "w", 1.0), (3650, "w", 1.0)]
    d, path = events(spark, data), str(tmp_path / "in")
    tidy = lambda x: rows(x.select("metric", F.col("session.start").cast("timestamp_ntz"), F.col("session.end").cast("timestamp_ntz"), "events"))
    batch = tidy(streams.sessions(d, "metric"))
    assert [r[3] for r in batch if r[0] == "u"] == [3, 1]
    plain = d.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", "3600 seconds").alias("session"), "metric").agg(
        F.count("*").alias("events"))
    assert batch == tidy(plain)
    land(d, path)
    land(events(spark, CLOSER), path)
    streams.run_once(streams.sessions(stream_of(spark, path), "metric"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert tidy(spark.read.parquet(str(tmp_path / "o"))) == batch


def test_status_upsert(spark, tmp_path):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    land(events(spark, [(1, "a", 1.0), (2, "b", 1.0)]), path)
    land(events(spark, [(5, "a", 7.0)]), path)
    stream = streams.latest_status(stream_of(spark, path), ["metric"], "value")
    streams.upsert_once(stream, ["metric"], out, cp)
    assert rows(streams.current_version(spark, out).select("metric", "status")) == [("a", 7.0), ("b", 1.0)]
    # Only the bucket of the changed key has a second version; old versions go.
    assert {r[0] for r in streams.current_version(spark, out).select("version").collect()} == {0, 1}
    for n in range(3):
        land(events(spark, [(10 + n, "a", 10.0 + n)]), path)
        streams.upsert_once(streams.latest_status(stream_of(spark, path), ["metric"], "value"), ["metric"], out, cp)
    assert rows(streams.current_version(spark, out).select("metric", "status")) == [("a", 12.0), ("b", 1.0)]
    kept = [p.parent.name for p in (tmp_path / "out").glob("version=*/bucket=*") if list(p.glob("*.parquet"))]
    assert len(kept) == 3


def test_repeats_within_time(spark, tmp_path):
    path = str(tmp_path / "in")
    land(events(spark, [(1, "a", 1.0), (3, "a", 1.0), (4, "b", 1.0)]), path)
    land(events(spark, [(5, "a", 1.0)]), path)
    streams.run_once(streams.without_repeats(stream_of(spark, path), ["metric"]), str(tmp_path / "o"), str(tmp_path / "c"))
    assert rows(spark.read.parquet(str(tmp_path / "o")).select("metric")) == [("a",), ("b",)]


def test_file_arrivals(spark, tmp_path):
    folder = tmp_path / "a" / "cycle3" / "adverse" / "run001"
    folder.mkdir(parents=True)
    write(folder / "bs.csv", "x\n1\n")
    depth = len(str(tmp_path).split("/"))  # position of 'a' in file:/…
    files = streams.arriving_files(spark, str(tmp_path / "a"), "*.csv")
    cat = streams.arrival_catalogue(files, depth + 1, depth + 2, depth + 3)
    streams.run_once(cat, str(tmp_path / "o"), str(tmp_path / "c"))
    first = spark.read.parquet(str(tmp_path / "o")).collect()
    assert len(first) == 1 and first[0]["table_name"] == "bs" and first[0]["creation_date"] is not None
    assert [first[0][c] for c in ("cycle", "scenario", "run_id")] == ["cycle3", "adverse", "run001"]
    write(folder / "pl.csv", "x\n1\n")
    files = streams.arriving_files(spark, str(tmp_path / "a"), "*.csv")
    streams.run_once(streams.arrival_catalogue(files, depth + 1, depth + 2, depth + 3), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r["table_name"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["bs", "pl"]

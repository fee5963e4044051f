"""Registered queries: alarms, sessions, status and repeats, over the batch and as real streams.

The stream versions read the events file as a file source, run once over everything available,
write Parquet and read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..registry import query, table
from ..sources import sinks
from ..streaming import alarm_states, streams
from .inputs import FILE_PATHS, file_paths, sql_with


def events(spark, sf):
    return table(spark, sf, "events")


def event_stream(spark, sf):
    return spark.readStream.schema(events(spark, sf).schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def sliced_stream(spark, sf, slices: int = 4):
    """The events in folders of consecutive time slices, written in one pass by as many tasks as their size asks for.
    A batch takes one file; files of earlier slices come first, since they are older or their paths sort first."""
    e = events(spark, sf)
    out = sinks.scratch(spark, "slices")
    span = e.agg(F.struct(F.unix_micros(F.min("ts").cast("timestamp")).alias("low"), F.unix_micros(F.max("ts").cast("timestamp")).alias("high"))).scalar()
    sliced = e.withColumn("span", span)
    at = F.try_divide(F.unix_micros(F.col("ts").cast("timestamp")) - F.col("span.low"), F.col("span.high") - F.col("span.low")) * slices
    sliced = sliced.withColumn("slice", F.least(F.coalesce(F.floor(at), F.lit(0)), F.lit(slices - 1)).cast("int")).drop("span")
    sliced.hint("rebalance", "slice").write.partitionBy("slice").parquet(out)
    for n in range(slices):  # a later slice is a later arrival
        touch(spark, f"{out}/slice={n}")
    return spark.readStream.schema(T.StructType([*e.schema.fields, T.StructField("slice", T.IntegerType())])).option("maxFilesPerTrigger", 1).parquet(out).drop("slice")


def touch(spark, folder):
    """Gives the files of a folder times after those of the folders touched before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path):
        now = spark._jvm.java.lang.System.currentTimeMillis()
        for f in files.listStatus(path):
            files.setTimes(f.getPath(), now + 1000 * int(folder.rsplit("=", 1)[1]), -1)


def run_stream(spark, stream, mode="append"):
    out = sinks.scratch(spark, "stream")
    streams.run_once(stream, f"{out}/rows", f"{out}/checkpoint", mode)
    return spark.read.parquet(f"{out}/rows")


PERIODS = """periods AS (SELECT time_bucket(INTERVAL 300 SECONDS, ts, TIMESTAMP '2000-01-01') AS start, event_type, sum(value) AS total, avg(value) AS mean, count(value) AS n
  FROM events GROUP BY 1, 2), closed AS (SELECT max(ts) - INTERVAL 10 MINUTES AS until FROM events)"""
PERIOD_ROWS = "start AS period_start, event_type, round(total, 2) AS total, round(mean, 6) AS mean, n"


def period_rows(df):
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("period_start"), "event_type",
                     F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), "n")


@query("stm2_alarms", sql_with(PERIODS) + f"SELECT {PERIOD_ROWS} FROM periods WHERE total > 60")
def stm2(spark, sf):
    return period_rows(streams.alarms(events(spark, sf), "event_type", "value", 60.0))


@query("stm2_alarms_stream", sql_with(PERIODS) + f"SELECT {PERIOD_ROWS} FROM periods, closed WHERE total > 60 AND start + INTERVAL 300 SECONDS <= until")
def stm2_stream(spark, sf):
    return period_rows(run_stream(spark, streams.alarms(event_stream(spark, sf), "event_type", "value", 60.0)))


SUSTAINED = """, b AS (SELECT event_type, start FROM periods WHERE mean > 20)
SELECT b.event_type, b.start AS period_start FROM b JOIN b p ON p.event_type = b.event_type AND p.start = b.start - INTERVAL 300 SECONDS"""


@query("stm3_sustained_alarms", sql_with(PERIODS) + SUSTAINED)
def stm3(spark, sf):
    s = streams.sustained_alarms(events(spark, sf), "event_type", "value", 20.0, "mean")
    return s.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query("stm3_sustained_alarms_stream", sql_with(PERIODS) + SUSTAINED + " , closed WHERE b.start + INTERVAL 300 SECONDS <= until")
def stm3_stream(spark, sf):
    s = streams.sustained_alarms(event_stream(spark, sf), "event_type", "value", 20.0, "mean")
    return run_stream(spark, s).withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


# A period without events is quiet; a change needs two periods of its kind in a row.
CHANGES = """, calendar AS (SELECT event_type, unnest(generate_series(min(start), (SELECT time_bucket(INTERVAL 300 SECONDS, until, TIMESTAMP '2000-01-01') FROM closed) - INTERVAL 300 SECONDS, INTERVAL 300 SECONDS)) AS start
  FROM periods GROUP BY 1),
told AS (SELECT c.event_type, c.start, coalesce(mean > 20, false) AS breach FROM calendar c LEFT JOIN periods p ON p.event_type = c.event_type AND p.start = c.start),
islands AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY start) - row_number() OVER (PARTITION BY event_type, breach ORDER BY start) AS island FROM told),
places AS (SELECT *, row_number() OVER (PARTITION BY event_type, breach, island ORDER BY start) AS place FROM islands),
votes AS (SELECT event_type, start, breach, lag(breach, 1, false) OVER (PARTITION BY event_type ORDER BY start) AS before FROM places WHERE place = 2)
SELECT event_type, start AS period_start, CASE WHEN breach THEN 'ALARM' ELSE 'OK' END AS state FROM votes WHERE breach <> before"""


def change_rows(df):
    return df.select("event_type", F.col("period_start").cast("timestamp_ntz").alias("period_start"), "state")


@query("stm3_alarm_changes", sql_with(PERIODS) + CHANGES)
def stm3_changes(spark, sf):
    return change_rows(alarm_states.alarm_changes(events(spark, sf), "event_type", "value", 20.0))


@query("stm3_alarm_changes_stream", sql_with(PERIODS) + CHANGES)
def stm3_changes_stream(spark, sf):
    """Four slices by time, each a micro-batch of its own."""
    out = sinks.scratch(spark, "changes")
    alarm_states.run_once(alarm_states.alarm_changes(sliced_stream(spark, sf), "event_type", "value", 20.0), f"{out}/rows", f"{out}/checkpoint")
    return change_rows(spark.read.parquet(f"{out}/rows"))


STATUS = """SELECT user_id, props AS step, arg_max(event_type, {'ts': ts, 'id': event_id}) AS status, max(ts) AS completed_at, count(*) AS changes FROM events GROUP BY 1, 2"""


@query("stm4_latest_status", STATUS)
def stm4(spark, sf):
    log = events(spark, sf).withColumnRenamed("props", "step")
    return streams.latest_status(log, ["user_id", "step"], "event_type", "ts", "event_id")


@query("stm4_latest_status_stream", STATUS)
def stm4_stream(spark, sf):
    """Four slices by time, each a micro-batch of its own."""
    log = sliced_stream(spark, sf).withColumnRenamed("props", "step")
    out = sinks.scratch(spark, "status")
    streams.upsert_once(streams.latest_status(log, ["user_id", "step"], "event_type", "ts", "event_id"), ["user_id", "step"], f"{out}/table", f"{out}/checkpoint")
    return streams.current_version(spark, f"{out}/table").drop("version", "bucket")


SESSIONS = """, s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s),
sessions AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 3600 SECONDS AS session_end, count(*) AS events FROM n GROUP BY user_id, no)"""


def session_rows(df):
    return df.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("session_start"),
                     F.col("session.end").cast("timestamp_ntz").alias("session_end"), "events")


@query("stm5_sessions", sql_with(PERIODS) + SESSIONS + " SELECT * FROM sessions")
def stm5(spark, sf):
    return session_rows(streams.sessions(events(spark, sf), "user_id"))


@query("stm5_sessions_stream", sql_with(PERIODS) + SESSIONS + " SELECT sessions.* FROM sessions, closed WHERE session_end <= until")
def stm5_stream(spark, sf):
    return session_rows(run_stream(spark, streams.sessions(event_stream(spark, sf), "user_id")))


@query("stm6_without_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def stm6(spark, sf):
    return streams.without_repeats(events(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type")


@query("stm6_without_repeats_stream", "SELECT DISTINCT user_id, event_type FROM events")
def stm6_stream(spark, sf):
    return run_stream(spark, streams.without_repeats(event_stream(spark, sf), ["user_id", "event_type"])).select("user_id", "event_type")


@query("stm1_arrival_catalogue", sql_with(FILE_PATHS) + """SELECT o_orderkey, cycle, scn AS scenario, run_id, file_name AS table_name, 'cycle,scenario,run_id' AS partitions,
'Balance sheet data for ' || scn || ' scenario, ' || run_id || ', cycle ' || cycle AS description FROM paths""")
def stm1(spark, sf):
    rows = streams.arrival_catalogue(file_paths(spark, sf), 2, 3, 4)
    return rows.withColumn("o_orderkey", F.regexp_extract("path", r"orders_([0-9]+)\.CSV$", 1).cast("bigint")).select(
        "o_orderkey", "cycle", "scenario", "run_id", "table_name", "partitions", "description")


@query("stm1_arrivals_stream", sql_with(FILE_PATHS) + """SELECT DISTINCT cycle, scn AS scenario, run_id, 'cycle,scenario,run_id' AS partitions,
'Balance sheet data for ' || scn || ' scenario, ' || run_id || ', cycle ' || cycle AS description, true AS dated FROM paths""")
def stm1_stream(spark, sf):
    """Orders written into folders by cycle, scenario and run; every file that arrives gives its catalogue row."""
    out = sinks.scratch(spark, "arrivals")
    parts = F.split("path", "/")
    rows = file_paths(spark, sf).select("o_orderkey", "o_totalprice", *[F.get(parts, F.lit(i)).alias(n) for i, n in ((2, "a"), (3, "b"), (4, "c"))])
    rows.hint("rebalance", "a", "b", "c").write.partitionBy("a", "b", "c").parquet(out)
    files = streams.arriving_files(spark, out, "*.parquet")
    plain = files.withColumn("path", F.regexp_replace("path", "^.*/a=([^/]*)/b=([^/]*)/c=([^/]*)/([^/]*)$", "$1/$2/$3/$4"))
    found = run_stream(spark, streams.arrival_catalogue(plain, 0, 1, 2))
    return found.groupBy("cycle", "scenario", "run_id", "partitions", "description").agg(F.bool_and(F.col("creation_date").isNotNull()).alias("dated"))

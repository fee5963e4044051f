"""Alarm states: the rule, the batch form and the keyed stream with a gap and a restart."""

import random
from datetime import datetime, timedelta

import pytest

from crosstally.sources.sinks import scratch
from crosstally.streaming import alarm_states as a

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, metric string, value double"


def brute(rows, breaches, quiets, missing, until):
    """Changes by going through all closed periods of each metric."""
    sums = {}
    for ts, metric, value in rows:
        if value is not None:
            sums.setdefault(metric, {}).setdefault(int((ts - START).total_seconds()) // 300, []).append(value)
        else:
            sums.setdefault(metric, {}).setdefault(int((ts - START).total_seconds()) // 300, [])
    out = []
    for metric, periods in sums.items():
        state = (0, False, 0, 0)
        for p in range(min(periods), int((until - START).total_seconds()) // 300):
            values = periods.get(p)
            state, change = a.advance(state, sum(values) / len(values) > 10 if values else None, breaches, quiets, 300, missing)
            if change:
                out.append((metric, START + timedelta(seconds=300 * p), change))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.metric, r.period_start, r.state) for r in df.collect()), key=repr)


def some(seed, start=0, hours=6, metrics=("a", "b", None)):
    rng, rows = random.Random(seed), []
    for minute in range(start, start + 60 * hours):
        for m in metrics:
            # Phases of high and low values, with silent stretches.
            if rng.random() < 0.3 and (minute // 70) % 3 != 2:
                rows.append((START + timedelta(minutes=minute, seconds=rng.randrange(60)), m, rng.choice([None, 3.0, 30.0, 12.0, 15.0])))
    return rows


@pytest.mark.parametrize("breaches,quiets,missing", [(2, 2, a.QUIET), (1, 3, a.QUIET), (2, 1, a.BREACHING), (3, 2, a.IGNORED)])
def test_batch_equals_brute_force(spark, breaches, quiets, missing):
    rows = some(breaches + quiets)
    until = max(r[0] for r in rows) - timedelta(minutes=10)
    got = found(a.alarm_changes(spark.createDataFrame(rows, SCHEMA), "metric", "value", 10.0, breaches=breaches, quiets=quiets, missing=missing))
    assert got == brute(rows, breaches, quiets, missing, until) and len(got) > 3


def test_each_change_once():
    state, told = (0, False, 0, 0), []
    for breach in [True, True, True, False, True, False, False, None, True, None, True, True]:
        state, change = a.advance(state, breach, 2, 2, 300, a.QUIET)
        told.append(change)
    assert told == [None, "ALARM", None, None, None, None, "OK", None, None, None, None, "ALARM"]
    with pytest.raises(ValueError):
        a._checked(0, 1, a.QUIET)


@pytest.mark.parametrize("missing", [a.QUIET, a.BREACHING])
def test_stream_with_gap_and_restart(spark, tmp_path, missing):
    """One metric falls silent while another goes on; the stream stops and goes on from its checkpoint."""
    folder, out = str(tmp_path / "in"), scratch(spark, "alarm-test")
    batches = [some(1, 0, 2), some(2, 120, 2), [(t, "a", 1.0) for t, _, _ in some(3, 240, 3)], some(4, 420, 2)]
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    done = []
    for part in (batches[:2], batches[2:]):
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            done += rows
        a.run_once(a.alarm_changes(stream(), "metric", "value", 10.0, missing=missing), f"{out}/rows", f"{out}/checkpoint")
        until = max(r[0] for r in done) - timedelta(minutes=10)
        got = found(spark.read.schema("metric string, period_start timestamp, state string").parquet(f"{out}/rows"))
        assert got == brute(done, 2, 2, missing, until)
    # "b" is silent at the end of the first part and for three hours of the second.
    assert {r[2] for r in got if r[0] == "b"} == ({"OK", "ALARM"} if missing == a.QUIET else {"ALARM"})


def test_no_events(spark):
    assert a.alarm_changes(spark.createDataFrame([], SCHEMA), "metric", "value", 10.0).count() == 0

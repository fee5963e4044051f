"""Alarm states per metric: OK to ALARM after breaching periods, back to OK after quiet ones, each change once.

Events are summed up per metric and period first, so what a metric's state sees is as long as the calendar. A stream
keeps a small state per metric (the next period due, the state, how many periods in a row spoke for a change) with an
event-time timer: a metric that falls silent still returns to OK when the watermark closes its quiet periods. A batch
finds the same changes by islands of equal periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from . import streams
from .streams import BREACHES, LATENESS, PERIOD_SECONDS, period_figures

OK, ALARM = "OK", "ALARM"
# What a period without any event counts as.
QUIET, BREACHING, IGNORED = "quiet", "breaching", "ignored"
STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "due bigint, alarm boolean, breaches int, quiets int"


def _checked(breaches: int, quiets: int, missing: str) -> None:
    if breaches < 1 or quiets < 1 or missing not in (QUIET, BREACHING, IGNORED):
        raise ValueError("give at least one period of each kind, and quiet, breaching or ignored for missing data")


def advance(state: tuple[int, bool, int, int], breach: bool | None, breaches: int, quiets: int, period: int, missing: str) -> tuple[tuple[int, bool, int, int], str | None]:
    """The state after one period (``breach`` is null without data), and what it changed to, if it did."""
    due, alarm, b, n = state
    if breach is None:
        breach = None if missing == IGNORED else missing == BREACHING
    if breach is None:
        return (due + period, alarm, b, n), None
    b, n = (min(b + 1, breaches), 0) if breach else (0, min(n + 1, quiets))
    if not alarm and b == breaches:
        return (due + period, True, b, n), ALARM
    if alarm and n == quiets:
        return (due + period, False, b, n), OK
    return (due + period, alarm, b, n), None


def alarm_changes(events: DataFrame, metric: str, value: str, threshold: float, statistic: str = "mean", breaches: int = BREACHES, quiets: int = BREACHES,
                  missing: str = QUIET, ts: str = "ts", seconds: int = PERIOD_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Changes of state: ``metric, period_start`` (of the period that completed the change), ``state``.

    A metric starts as OK with its first period. After ``breaches`` breaching periods in a row it is in ALARM, after
    ``quiets`` other ones OK again. Periods are looked at once the watermark has closed them; a batch takes
    ``lateness`` before the newest event of all metrics for the watermark. Rows without metric are a metric of their own; null
    values do not count, a period of nulls only has no data.
    """
    _checked(breaches, quiets, missing)
    over = F.when(F.col("n") > 0, F.col(statistic) > threshold)
    figures = period_figures(events, metric, value, ts, seconds, lateness)
    if not events.isStreaming:
        return _batch(events, figures.select(metric, F.unix_seconds("window.start").alias("start"), over.alias("breach")), metric, breaches, quiets, missing, ts, seconds, lateness)
    closed = figures.select(metric, F.window_time("window").alias("at"), F.unix_seconds("window.start").alias("start"), over.alias("breach"))

    kind = closed.schema[metric].dataType.simpleString()
    machine = Machine(breaches, quiets, seconds, missing)
    found = closed.groupBy(metric).transformWithStateInPandas(machine, f"metric {kind}, start bigint, state string", "Append", "EventTime")
    return found.select(F.col("metric").alias(metric), F.timestamp_seconds("start").alias("period_start"), "state")


def run_once(changes: DataFrame, out: str, checkpoint: str) -> None:
    """:func:`streams.run_once` with the state store that keyed states with timers need; the session's own comes back."""
    conf = changes.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, PROVIDER)
    try:
        streams.run_once(changes, out, checkpoint)
    finally:
        conf.set(STORE, before)


class Machine(StatefulProcessor):
    """One metric's state; see :func:`alarm_changes`. Needs a session whose state store is RocksDB."""

    def __init__(self, breaches: int, quiets: int, seconds: int, missing: str):
        self.rule, self.seconds, self.missing = (breaches, quiets, seconds, missing), seconds, missing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = {int(s): None if pd.isna(b) else bool(b) for p in rows for s, b in zip(p["start"], p["breach"])}
        yield from self._advanced(key, known, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, {}, timerValues)

    def close(self) -> None:
        pass

    def _advanced(self, key: tuple, known: dict[int, bool | None], times: TimerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else (min(known), False, 0, 0)
        # Up to the last period that came, and on to those that the watermark has closed.
        end, changes = max([*known, times.getCurrentWatermarkInMs() // 1000 - self.seconds]), []
        while now[0] <= end:
            start = now[0]
            now, change = advance(now, known.get(start), *self.rule)
            if change:
                changes.append((start, change))
        self.state.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Silence can change something only from the one state, or break a row that is being counted.
        alarm, breaches = now[1:3]
        if self.missing == QUIET and (alarm or breaches) or self.missing == BREACHING and not alarm:
            self.handle.registerTimer((now[0] + self.seconds) * 1000)
        if changes:
            yield pd.DataFrame({"metric": [key[0]] * len(changes), "start": [s for s, _ in changes], "state": [c for _, c in changes]})


def _batch(events: DataFrame, figures: DataFrame, metric: str, breaches: int, quiets: int, missing: str, ts: str, seconds: int, lateness: str) -> DataFrame:
    until = F.unix_seconds((F.max(F.col(ts).cast("timestamp")) - F.expr(f"interval {lateness}")))
    last = F.floor(events.agg(until).scalar() / seconds).cast("bigint") * seconds - seconds
    closed = figures.withColumn("last", last).filter(F.col("start") <= F.col("last"))
    spans = closed.groupBy(metric).agg(F.min("start").alias("first"), F.max("last").alias("last"))
    calendar = spans.select(F.col(metric).alias("m"), F.explode(F.sequence("first", "last", F.lit(seconds))).alias("s"))
    all_periods = calendar.join(closed, F.col("m").eqNullSafe(F.col(metric)) & (F.col("s") == F.col("start")), "left")
    none = {QUIET: F.lit(False), BREACHING: F.lit(True), IGNORED: F.lit(None).cast("boolean")}[missing]
    told = all_periods.select("m", "s", F.coalesce("breach", none).alias("breach")).filter("breach is not null")
    by_time = Window.partitionBy("m").orderBy("s")
    # Periods of one kind in a row share the difference of two numberings.
    numbered = told.withColumn("island", F.row_number().over(by_time) - F.row_number().over(Window.partitionBy("m", "breach").orderBy("s")))
    place = F.row_number().over(Window.partitionBy("m", "breach", "island").orderBy("s"))
    full = numbered.withColumn("place", place).filter(F.col("place") == F.when(F.col("breach"), breaches).otherwise(quiets))
    changed = full.withColumn("before", F.lag("breach", 1, False).over(by_time)).filter(F.col("breach") != F.col("before"))
    return changed.select(F.col("m").alias(metric), F.timestamp_seconds("s").alias("period_start"), F.when(F.col("breach"), ALARM).otherwise(OK).alias("state"))

"""Seasonal forecasts and names by many patterns."""

import math
import random

import numpy as np
import pytest

from crosstally.operators import patterns, seasonal


def design(steps, first, span, periods, harmonics):
    return np.array([[1.0, (s - first) / span, *[f(2 * math.pi * h * (s - first) / p) for p in periods for h in range(1, harmonics + 1) for f in (math.cos, math.sin)]] for s in steps])


def test_forecast_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    data, want = [], {}
    for g, n in (("a", 90), ("b", 40), (None, 25)):
        steps = sorted(rng.choice(120, n, replace=False).tolist())
        values = [5 + 0.3 * s + 4 * math.sin(2 * math.pi * s / 7) + float(rng.normal()) for s in steps]
        data += [(g, int(s), v) for s, v in zip(steps, values)]
        x = design(steps, steps[0], steps[-1] - steps[0], (7.0, 30.0), 2)
        beta, inverse = np.linalg.lstsq(x, np.array(values), rcond=None)[0], np.linalg.inv(x.T @ x)
        sigma = math.sqrt(((np.array(values) - x @ beta) ** 2).sum() / (n - x.shape[1]))
        for s in range(steps[-1] + 1, steps[-1] + 4):
            f = design([s], steps[0], steps[-1] - steps[0], (7.0, 30.0), 2)[0]
            reach = 1.96 * sigma * math.sqrt(1 + f @ inverse @ f)
            want[g, s] = (f @ beta, f @ beta - reach, f @ beta + reach, 10)
    df = spark.createDataFrame(data + [("a", None, 1.0), ("b", 3, None)], "g string, step int, v double").repartition(4)
    got = {(r.g, r.step): (r.forecast, r.low, r.high, r.terms) for r in seasonal.seasonal_forecast(df, "g", "step", "v", 3, (7.0, 30.0)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6), k


def test_planted_season_is_exact(spark):
    value = lambda s: 2 + 0.5 * s + 3 * math.cos(2 * math.pi * s / 7) - math.sin(4 * math.pi * s / 7)
    df = spark.createDataFrame([("g", s, value(s)) for s in range(60)], "g string, step int, v double")
    for r in seasonal.seasonal_forecast(df, "g", "step", "v", 14).collect():
        assert r.forecast == pytest.approx(value(r.step), abs=1e-6) and r.high - r.low < 1e-4


def test_short_and_regular_groups_fall_back(spark):
    data = [("one", 5, 3.0), ("two", 1, 1.0), ("two", 2, 3.0), ("line", 0, 0.0), ("line", 1, 2.0), ("line", 2, 4.0), ("same", 4, 1.0), ("same", 4, 3.0)]
    data += [("weekly", 7 * i, float(i)) for i in range(40)]  # one day a week tells nothing of the week
    got = {}
    for r in seasonal.seasonal_forecast(spark.createDataFrame(data, "g string, step int, v double"), "g", "step", "v", 1).collect():
        got[r.g] = (r.step, round(r.forecast, 6), r.terms, r.low is None)
    assert got == {"one": (6, 3.0, 1, True), "two": (3, 2.0, 1, False), "line": (3, 6.0, 2, False), "same": (5, 2.0, 1, False), "weekly": (274, round(274 / 7, 6), 2, False)}
    assert seasonal.seasonal_forecast(spark.createDataFrame([], "g string, step int, v double"), "g", "step", "v", 2).count() == 0


@pytest.mark.parametrize("most_bytes", [patterns.MOST_BYTES, 1 << 20])
def test_ten_thousand_patterns_equal_the_ladder(spark, most_bytes):
    rng = random.Random(5)
    made = lambda n: "".join(rng.choices("abcdeé", k=n))
    rules = [(made(rng.randint(3, 9)).capitalize(), rng.randrange(2000), f"name{rng.randrange(500)}") for _ in range(10_000)]
    texts = [made(rng.randint(0, 40)).upper() for _ in range(300)] + [None, "", "xyz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    table = spark.createDataFrame(rules + [("", 0, "empty"), (None, 0, "null"), ("abc", None, "no priority")], "pattern string, priority int, name string")
    got = {r.id: r.name for r in patterns.first_match(df, "body", table, most_bytes=most_bytes).collect()}
    ordered = sorted((p, n, s.lower()) for s, p, n in rules)
    for i, t in enumerate(texts):
        assert got[i] == next((n for _, n, s in ordered if s in (t or "").lower()), "Unknown")
    assert {"Unknown"} < set(got.values())


def test_no_patterns(spark):
    df = spark.createDataFrame([("a",), (None,)], "body string")
    got = patterns.first_match(df, "body", spark.createDataFrame([], "pattern string, priority int, name string"), "owner")
    assert [r.owner for r in got.collect()] == ["Unknown", "Unknown"]

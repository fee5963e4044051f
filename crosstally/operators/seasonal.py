"""Seasonal forecasts: a line and a few waves per group, by least squares from sums.

Spark sums the products of all pairs of terms per group in one aggregation, reduced in the map tasks; what is solved is
one small system of equations a group. Where a group has too few or too regular values for the waves (the system is
badly conditioned), a line is fitted, then the mean alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .joins import join_totals
from .schema import q

# A system whose condition number is beyond this is not solved.
WORST_CONDITION = 1e10
# Of the normal distribution: two sided, 95 percent.
Z = 1.96


def term_columns(step: Column, first: Column, span: Column, periods: list[float], harmonics: int) -> list[Column]:
    """1, the time in shares of the observed span, and a cosine and a sine for each harmonic of each period."""
    turn = lambda p, h: (step - first) * (2 * math.pi * h / p)
    waves = [f(turn(p, h)) for p in periods for h in range(1, harmonics + 1) for f in (F.cos, F.sin)]
    return [F.lit(1.0), (step - first) / span, *waves]


def solve(gram: np.ndarray, moments: np.ndarray, squares: float, n: int) -> tuple[np.ndarray, np.ndarray, float | None, int]:
    """Coefficients, inverse of the system, residual deviation (null without spare values), number of terms fitted."""
    size = len(moments)
    for terms in dict.fromkeys((size, 2, 1)):
        part = gram[:terms, :terms]
        if n >= terms and (terms == 1 or n > terms and np.linalg.cond(part) < WORST_CONDITION):
            inverse, beta = np.zeros((size, size)), np.zeros(size)
            inverse[:terms, :terms] = np.linalg.inv(part)
            beta[:terms] = np.linalg.solve(part, moments[:terms])
            left = max(0.0, squares - float(beta @ moments))
            return beta, inverse, math.sqrt(left / (n - terms)) if n > terms else None, terms
    raise ValueError("a group without values")


def seasonal_forecast(series: DataFrame, group: str, step: str, value: str, ahead: int, periods: tuple[float, ...] = (7.0,), harmonics: int = 2) -> DataFrame:
    """``group, step, forecast, low, high, terms`` for ``ahead`` steps after each group's last one.

    ``low`` and ``high`` bound the next value with 95 percent probability if the residuals are normal; they are null where
    no value is left over to measure these. Rows without step or value do not count, steps may be missing or repeated;
    rows without group are a group. ``terms`` tells what was fitted: all, 2 (a line) or 1 (the mean).
    """
    rows = series.select(q(group).alias("__g"), q(step).cast("double").alias("__x"), q(value).cast("double").alias("__y")).dropna(subset=["__x", "__y"])
    spans = rows.groupBy("__g").agg(F.min("__x").alias("first"), F.max("__x").alias("last"))
    spans = spans.withColumn("span", F.greatest(F.col("last") - F.col("first"), F.lit(1.0)))
    fits = term_columns(F.col("__x"), F.col("first"), F.col("span"), list(periods), harmonics)
    size = len(fits)
    with_terms = join_totals(rows, spans, ["__g"]).select("__g", "__y", "first", "last", "span", *[t.alias(f"t{i}") for i, t in enumerate(fits)])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = with_terms.groupBy("__g", "first", "last", "span").agg(
        F.count("*").alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("squares"), F.array(*[F.sum(F.col(f"t{i}") * F.col("__y")) for i in range(size)]).alias("moments"),
        F.array(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in pairs]).alias("gram"))

    @F.pandas_udf("beta array<double>, inverse array<double>, sigma double, terms int")
    def solved(gram: pd.Series, moments: pd.Series, squares: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for g, m, s, k in zip(gram, moments, squares, n):
            full = np.zeros((size, size))
            for (i, j), x in zip(pairs, g):
                full[i, j] = full[j, i] = x
            beta, inverse, sigma, terms = solve(full, np.array(m, float), s, k)
            out.append((beta.tolist(), inverse.ravel().tolist(), sigma, terms))
        return pd.DataFrame(out, columns=["beta", "inverse", "sigma", "terms"])

    fit = sums.withColumn("f", solved("gram", "moments", "squares", "n")).select("__g", "first", "last", "span", "f.*")
    steps = fit.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(ahead)))).withColumn("at", F.col("last") + F.col("at"))
    steps = steps.withColumn("x", F.array(*term_columns(F.col("at"), F.col("first"), F.col("span"), list(periods), harmonics)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    steps = steps.withColumn("xx", F.array(*[F.get("x", F.lit(i)) * F.get("x", F.lit(j)) for i in range(size) for j in range(size)]))
    reach = Z * F.col("sigma") * F.sqrt(1 + F.greatest(dot(F.col("inverse"), F.col("xx")), F.lit(0.0)))
    forecast = dot(F.col("beta"), F.col("x"))
    return steps.select(F.col("__g").alias(group), F.col("at").cast("bigint").alias(step), forecast.alias("forecast"), (forecast - reach).alias("low"), (forecast + reach).alias("high"), "terms")

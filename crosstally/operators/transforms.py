"""General table transforms: crosstab, transpose, sampling, filling, scaling, trends, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import figures, join_totals
from .measures import quartiles
from .schema import q


def crosstab(df: DataFrame, row: str, column: str, values: list, measure: str | None = None) -> DataFrame:
    """Counts, or sums of a measure, by row and column value; empty cells are 0.

    The column values are named by the caller, so no extra pass looks for them.
    """
    cell = F.count(F.lit(1)) if measure is None else F.sum(q(measure))
    wide = df.groupBy(q(row)).pivot(column, values).agg(cell)
    return wide.na.fill(0, [str(v) for v in values])


def transpose(df: DataFrame, index: str, labels: list[str], columns: list[str]) -> DataFrame:
    """Columns become rows and the named index labels become columns."""
    long = df.unpivot([index], columns, "column", "value")
    return long.groupBy("column").pivot(index, labels).agg(F.first("value"))


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Reproducible sample: a row is kept by the hash of its key, whatever the partitioning."""
    number = F.conv(F.substring(F.md5(q(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.filter(number % 1_000_000 < int(fraction * 1_000_000))


def random_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def append(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def fill_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.na.fill(values)


def fill_with_mean(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(q(column)).alias("m")).scalar()
    return df.withColumn(column, F.coalesce(q(column), mean))


def _scaled(df: DataFrame, column: str, by: list[str], out: str, stats_of: dict[str, Column], formula) -> DataFrame:
    if by:
        stats = df.groupBy(*[q(b) for b in by]).agg(*[c.alias(n) for n, c in stats_of.items()])
        wide = join_totals(df, stats, by)
    else:
        wide = df.withColumn("__f", figures(df, **stats_of)).select("*", "__f.*").drop("__f")
    return wide.withColumn(out, formula(q(column), *[F.col(n) for n in stats_of])).drop(*stats_of)


def min_max(df: DataFrame, column: str, by: list[str] | None = None, out: str = "scaled") -> DataFrame:
    """Scale to 0..1, over all rows or per group; a constant column gives null."""
    c = q(column)
    return _scaled(df, column, by or [], out, {"__lo": F.min(c), "__hi": F.max(c)},
                   lambda v, lo, hi: F.try_divide(v - lo, hi - lo))


def z_score(df: DataFrame, column: str, by: list[str] | None = None, out: str = "z") -> DataFrame:
    c = q(column)
    return _scaled(df, column, by or [], out, {"__mean": F.avg(c), "__sd": F.stddev_samp(c)},
                   lambda v, mean, sd: F.try_divide(v - mean, sd))


def summarise(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Count, mean, spread, extremes and exact quartiles per group."""
    c = q(column)
    base = df.groupBy(*[q(b) for b in by]).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"))
    return join_totals(base, quartiles(df, by, column), by)


def compute(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """New columns from SQL expressions."""
    return df.withColumns({n: F.expr(f) for n, f in formulas.items()})


def anomalies(series: DataFrame, group: str, order: str, value: str, trailing: int = 7, limit: float = 2.0) -> DataFrame:
    """Flag points of a per-period series that lie ``limit`` deviations off the trailing mean.

    ``series`` holds one row per group and period, aggregated beforehand, so a group is as long as
    the calendar, not as the data.
    """
    w = Window.partitionBy(q(group)).orderBy(q(order)).rowsBetween(-trailing, -1)
    z = F.when(F.count(q(value)).over(w) == trailing,
               F.try_divide(q(value) - F.avg(q(value)).over(w), F.stddev_samp(q(value)).over(w)))
    return series.withColumn("z", z).withColumn("is_anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))


def linear_forecast(series: DataFrame, group: str, step: str, value: str, ahead: int) -> DataFrame:
    """Least-squares line per group, continued for ``ahead`` steps after the last one seen."""
    x, y = q(step).cast("double"), q(value).cast("double")
    fit = series.groupBy(q(group)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max(q(step)).alias("last"))
    steps = fit.select(q(group), "slope", "intercept", F.explode(F.sequence(F.col("last") + 1, F.col("last") + ahead)).alias(step))
    return steps.select(q(group), step, (F.col("intercept") + F.col("slope") * q(step)).alias("forecast"))

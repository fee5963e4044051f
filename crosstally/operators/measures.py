"""Chart-ready aggregates: counts, sums, top-n, bins, shares, correlations, quantiles."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import safe_ratio, threshold_flag, to_number
from ..sources.sinks import materialise
from .filters import all_of, equal_to, in_runs
from .joins import figures, join_totals, salted_totals
from .schema import q

# Revenue classes (upper bounds, each range open below and closed above) and their labels.
REVENUE_EDGES = (0, 1e6, 1e7, 1e8, 1e9, 1e10, math.inf)
REVENUE_LABELS = ("<1M", "1M-10M", "10M-100M", "100M-1B", "1B-10B", ">10B")
# Sector names by industry code prefix.
SECTORS = {
    "11": "Agriculture", "21": "Mining", "22": "Utilities",
    "23": "Construction", "31-33": "Manufacturing", "42": "Wholesale",
    "44-45": "Retail", "48-49": "Transport", "51": "Information",
    "52": "Finance", "53": "Real Estate", "54": "Professional",
    "56": "Admin", "61": "Education", "62": "Healthcare",
    "71": "Arts", "72": "Hospitality", "81": "Services",
}


def n_rows() -> Column:
    return F.count(F.lit(1))


def key_figures(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Row count and one conditional count per name, in a single pass."""
    return df.agg(n_rows().alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def count_by(df: DataFrame, *keys: str, keep_missing: bool = False) -> DataFrame:
    """Rows per key; rows with a missing key are left out unless kept on request."""
    kept = df if keep_missing else df.na.drop(subset=list(keys))
    return kept.groupBy(*[q(k) for k in keys]).agg(n_rows().alias("rows"))


def missing_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(q(column).isNull()).alias("missing"))


def top_categories(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return count_by(df, key).orderBy(F.desc("rows"), q(key)).limit(n)


def sum_by(df: DataFrame, keys: list[str], measure: str, out: str = "total") -> DataFrame:
    """Sum per key; missing keys are left out and an empty sum is 0."""
    return df.na.drop(subset=keys).groupBy(*[q(k) for k in keys]).agg(
        F.coalesce(F.sum(q(measure)), F.lit(0.0)).alias(out))


def top_by_sum(df: DataFrame, key: str, measure: str, n: int = 10) -> DataFrame:
    """Largest sums of a measure given as number or text; rows missing either value are left out."""
    clean = df.withColumn("__m", to_number(q(measure))).na.drop(subset=["__m", key])
    return clean.groupBy(q(key)).agg(F.sum("__m").alias("total")).orderBy(F.desc("total"), q(key)).limit(n)


def mean_by(df: DataFrame, key: str, measure: str) -> DataFrame:
    return df.na.drop(subset=[key]).groupBy(q(key)).agg(F.avg(q(measure)).alias("mean")).orderBy(q(key))


def distinct_and_mean_by(df: DataFrame, key: Column, name: str, counted: str, measure: str) -> DataFrame:
    """Distinct ids and mean measure per key expression. Grouping by (key, id) first spreads a hot key."""
    per_id = df.select(key.alias(name), q(counted).alias("__id"), q(measure).alias("__m")).filter(
        F.col(name).isNotNull()).groupBy(name, "__id").agg(F.sum("__m").alias("s"), F.count("__m").alias("n"))
    return per_id.groupBy(name).agg(
        F.count("__id").alias("distinct_ids"), safe_ratio(F.sum("s"), F.sum("n")).alias("mean"))


def sector_profile(df: DataFrame, code: str, company: str, percent: str, flag: str) -> DataFrame:
    """Per sector: distinct companies, mean percent, flagged rows and companies, shares in percent.

    ``flagged_share`` relates flagged companies to companies, so it stays within 100;
    ``flagged_rows_share`` relates flagged rows to companies and may exceed it.
    """
    from .schema import expand_code_ranges, label_codes
    sector = label_codes(F.substring(q(code).cast("string"), 1, 2), expand_code_ranges(SECTORS))
    per_company = df.select(
        sector.alias("sector"), q(company).alias("id"), q(percent).alias("p"), (q(flag) == "Y").alias("y"),
    ).filter(F.col("sector").isNotNull()).groupBy("sector", "id").agg(
        F.sum("p").alias("s"), F.count("p").alias("n"), F.count_if("y").alias("y"))
    companies = F.count("id")
    return per_company.groupBy("sector").agg(
        companies.alias("companies"),
        safe_ratio(F.sum("s"), F.sum("n")).alias("mean_percent"),
        F.sum("y").alias("flagged_rows"),
        (F.count_if(F.col("id").isNotNull() & (F.col("y") > 0)) / companies * 100).alias("flagged_share"),
        (F.sum("y") / companies * 100).alias("flagged_rows_share"),
    )


def totals(df: DataFrame, measures: list[str], only_if_present: list[str] | None = None) -> DataFrame:
    """Sums of measures over all rows, and over the rows in which ``only_if_present`` are all given."""
    out = [F.coalesce(F.sum(q(m)), F.lit(0.0)).alias(m) for m in measures]
    if only_if_present:
        whole = all_of([q(c).isNotNull() for c in only_if_present])
        out += [F.coalesce(F.sum(F.when(whole, q(m))), F.lit(0.0)).alias(f"{m}_complete") for m in only_if_present]
    return df.agg(*out)


def means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(q(c)).alias(c) for c in columns])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all column pairs over the rows in which both are given, long form.

    One aggregation for the whole matrix. Zero variance gives null.
    """
    pairs = [(a, a) for a in columns] + list(combinations(columns, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = q(a).isNotNull() & q(b).isNotNull()
        x, y = F.when(both, q(a)).cast("double"), F.when(both, q(b)).cast("double")
        # A constant column can show a spread of rounding size; compare the extremes instead.
        varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
        aggs.append(F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f"p{i}"))
    row = df.agg(*aggs)
    cells = []
    for i, (a, b) in enumerate(pairs):
        for l, r in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(l).alias("a"), F.lit(r).alias("b"), F.col(f"p{i}").alias("r")))
    return row.select(F.inline(F.array(*cells)))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column whether all given values are one and the same. Extremes suffice: no distinct count."""
    one = df.agg(*[F.coalesce(F.min(q(c)) == F.max(q(c)), F.lit(False)).alias(c) for c in columns])
    return one.unpivot([], [q(c) for c in columns], "column", "is_constant")


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Counts in equal bins over [low, high]; the top edge belongs to the last bin, other values drop out."""
    c = q(column)
    width = (high - low) / bins
    index = F.least(F.floor((c - low) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    inside = df.filter((c >= low) & (c <= high))
    return inside.groupBy(*[q(k) for k in by or []], index.alias("bin")).agg(n_rows().alias("rows")).withColumns({
        "bin_from": F.lit(low) + F.col("bin") * width, "bin_to": F.lit(low) + (F.col("bin") + 1) * width})


def histogram_over_range(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value found."""
    limits = figures(df, lo=F.min(q(column)), hi=F.max(q(column)))
    binned = df.filter(q(column).isNotNull()).select(q(column).alias("c"), limits.alias("s")).select("c", "s.*")
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.coalesce(F.floor(F.try_divide(F.col("c") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1))
    return binned.groupBy(index.cast("bigint").alias("bin"), "lo", "hi").agg(n_rows().alias("rows")).select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("bin_from"), "rows")


def value_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows per group and value (``v``, ``n``): copies of a value collapse in the map tasks."""
    return df.filter(q(column).isNotNull()).groupBy(*[q(k) for k in keys], q(column).cast("double").alias("v")).agg(
        n_rows().alias("n"))


def quantiles(df: DataFrame, keys: list[str], column: str, probs: list[float], most: int = 1 << 17) -> DataFrame:
    """Exact interpolated quantiles per group (one ``p``, ``value`` row each) without gathering a group in one task.

    Ranks are selected in rounds. A bracket starts as the whole group. While it holds more than ``most`` distinct
    values, a sketch of these cuts it into parts, the parts are counted, and the part of the wanted rank is the new
    bracket, a sixtieth of the old one or so. At last the few values left are ranked. What a task ranks never grows
    with the group, and copies of a value are one row. Reads ``df`` once; a round reads the counts twice.
    """
    group = [q(k) for k in keys]
    counted = materialise(value_counts(df, keys, column), "value-counts")
    totals = counted.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = totals.withColumn("below", F.lit(0).cast("bigint")).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in dict.fromkeys(probs)])))
    wanted = materialise(wanted, "brackets")
    while not wanted.filter(F.col("size") > most).isEmpty():
        wanted = materialise(wanted.filter(F.col("size") <= most).unionByName(_narrowed(counted, wanted.filter(F.col("size") > most), keys)), "brackets")
    position = (F.col("total") - 1) * F.col("p")
    held = salted_totals(counted, wanted, keys, F.col("v")).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    ranked = held.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy(*group, "p").orderBy("v")))
    at = lambda r: F.max(F.when((r >= F.col("upto") - F.col("n")) & (r < F.col("upto")), F.col("v")))
    return ranked.groupBy(*group, "p", "total").agg(at(F.floor(position)).alias("a"), at(F.ceil(position)).alias("b")).select(
        *group, "p", (F.col("a") + (F.col("b") - F.col("a")) * (position - F.floor(position))).alias("value"))


def _narrowed(counted: DataFrame, wide: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """The parts of wide brackets that hold the ranks on either side of the wanted position."""
    group = [q(k) for k in keys]
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    within = salted_totals(counted, wide, keys, F.col("v")).filter(inside)
    cuts = within.groupBy(*group, "p").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 1000).alias("cuts"))
    cut = materialise(join_totals(wide, cuts, [*keys, "p"]), "cut-brackets")
    placed = salted_totals(counted, cut, keys, F.col("v")).filter(inside).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    sums = placed.groupBy(*group, "p", "total", "below", "part").agg(F.sum("n").alias("n"), F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*group, "p").orderBy("part"))
    position = (F.col("total") - 1) * F.col("p")
    ranked = sums.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("n"))
    kept = ranked.filter((F.floor(position) < F.col("upto")) & (F.ceil(position) >= F.col("first")))
    return kept.groupBy(*group, "p", "total").agg(F.sum("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("below"))


def quartiles(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Exact quartiles per group as columns ``q1, median, q3``."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    return quantiles(df, keys, column, list(names)).groupBy(*[q(k) for k in keys]).agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()])


def box_statistics(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per group: extremes, quartiles, and the whisker ends (outermost values within 1.5 quartile ranges)."""
    v = F.col("v")
    rows = salted_totals(value_counts(df, keys, column), quartiles(df, keys, column), keys, v)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return rows.groupBy(*[q(k) for k in keys], "q1", "median", "q3").agg(
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.min(F.when(inside, v)).alias("lower_fence"), F.max(F.when(inside, v)).alias("upper_fence"))


def range_counts(df: DataFrame, column: str, edges=REVENUE_EDGES, labels=REVENUE_LABELS) -> DataFrame:
    """Rows per labelled range ``(low, high]``, in range order, empty ranges included."""
    c = q(column)
    counts = [F.count_if((c > lo) & (c <= hi)).alias(l) for lo, hi, l in zip(edges, edges[1:], labels)]
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(l).alias("label"), q(l).alias("rows"))
                      for i, l in enumerate(labels, 1)])
    return df.agg(*counts).select(F.inline(cells))


def density(df: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """Gaussian kernel density at the grid points, bandwidth by Scott's rule.

    Every distinct value is evaluated once against the fixed grid inside one aggregation.
    """
    v = q(column).cast("double")
    stats = figures(df, n=F.count(v), h=F.stddev_samp(v) * F.pow(F.count(v), F.lit(-0.2)))
    counts = df.filter(v.isNotNull()).groupBy(v.alias("v")).agg(n_rows().alias("c")).select("v", "c", stats.alias("s")).select("v", "c", "s.*")
    sums = [F.sum(F.col("c") * F.exp(-F.pow((F.lit(float(x)) - F.col("v")) / F.col("h"), F.lit(2.0)) / 2)
                  / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias(f"g{i}") for i, x in enumerate(grid)]
    cells = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col(f"g{i}").alias("density")) for i, x in enumerate(grid)])
    return counts.agg(*sums).select(F.inline(cells))


def hierarchical_totals(df: DataFrame, outer: str, inner: str, measure: str) -> DataFrame:
    """Sums at group, category and overall level; ``level`` 0 is the finest."""
    return df.rollup(q(outer), q(inner)).agg(F.sum(q(measure)).alias("total"), F.grouping_id().alias("gid")).withColumn(
        "level", F.when(F.col("gid") == 0, 0).when(F.col("gid") == 1, 1).otherwise(2)).drop("gid")


def axis_statistics(df: DataFrame, measure: str) -> DataFrame:
    """Extremes of the measure, whether a log axis fits, and the padded axis range."""
    lo, hi = F.min(q(measure)), F.max(q(measure))
    return df.agg(lo.alias("lo"), hi.alias("hi")).select(
        "lo", "hi",
        F.coalesce((F.col("lo") > 0) & (F.try_divide("hi", "lo") > 100), F.lit(False)).alias("use_log"),
        F.when(F.col("lo") > 0, F.col("lo") * 0.9).otherwise(F.col("lo") * 1.1).alias("range_min"),
        (F.col("hi") * 1.1).alias("range_max"))


def measure_by(df: DataFrame, measure: str, dimensions: list[str] | None = None, equals: dict | None = None,
               scenario: str | None = None, run_ids: list[str] | None = None) -> DataFrame:
    """Sum of a measure by dimensions, after equality filters and a scenario/run restriction."""
    if scenario is not None:
        df = in_runs(df, scenario, run_ids or [])
    return equal_to(df, equals or {}).groupBy(*[q(d) for d in dimensions or []]).agg(
        F.sum(q(measure)).alias(f"total_{measure}"))


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each row's part of the sum over all rows, the sum being a scalar subquery."""
    total = df.agg(F.sum(q(value)).alias("t")).scalar()
    return df.withColumn(out, F.try_divide(q(value), total))


def share_of_parent(df: DataFrame, parent: str, value: str, out: str = "share") -> DataFrame:
    parents = df.groupBy(q(parent)).agg(F.sum(q(value)).alias("__t"))
    return join_totals(df, parents, [parent]).withColumn(out, F.try_divide(q(value), F.col("__t"))).drop("__t")


def pick_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(q(column)).distinct().orderBy(q(column))


def flag_at(df: DataFrame, column: str, out: str, at_least: float) -> DataFrame:
    return df.withColumn(out, threshold_flag(q(column), at_least))

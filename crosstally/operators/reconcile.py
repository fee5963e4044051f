"""Reconciliation of company lists: joins, side-by-side comparison, set overlaps.

Comparison counts never build the pairs of a hot key: both sides are counted per key first
(partial aggregation in the map tasks), so the join has one row per key and side, and the
number of pairs is a product of two counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import as_text, robust_key
from ..functions.numbers import threshold_flag, to_number
from .joins import attach, fan_out_join
from .schema import q, select_present

# Column sets of the counterparty list and of the joined result.
COUNTERPARTY_COLUMNS = [
    "cob_date", "productype", "legal_entity", "counterparty_id", "counterparty_name",
    "parent_id", "group_id", "group_name", "bic_code", "country_code",
]
SCORE_COLUMNS = ["year", "totalRevenue", "greenRevenuePercent", "justification", "dataSources"]
FLAG_AT = 50


def match_scores(counterparties: DataFrame, scores: DataFrame, how: str = "inner",
                 left_name: str = "counterparty_name", right_name: str = "companyName",
                 make_key=robust_key) -> DataFrame:
    """Join distinct counterparties to scored companies on the normalised name and flag the score.

    Rows whose key is missing never match; they are dropped for an inner join and kept for a left join.
    """
    left = select_present(counterparties, COUNTERPARTY_COLUMNS).distinct().withColumn("join_key", make_key(q(left_name)))
    right = select_present(scores, [right_name, *SCORE_COLUMNS]).withColumn("join_key", make_key(q(right_name)))
    right = right.filter(F.col("join_key").isNotNull()).drop(right_name)
    if how == "left":
        joined = fan_out_join(left, right, "join_key", "join_key")
    else:
        joined = left.join(right, "join_key", how)
    percent = to_number(q("greenRevenuePercent"))
    return (
        select_present(joined, COUNTERPARTY_COLUMNS + SCORE_COLUMNS)
        .withColumn("greenRevenuePercent", percent)
        .withColumn("pure_play_flag", threshold_flag(percent, FLAG_AT))
    )


def keyed(df: DataFrame, column: str, make_key=robust_key, drop_missing: bool = True, out: str = "join_key") -> DataFrame:
    """Add the normalised key of ``column``; rows without key drop out unless told otherwise."""
    df = df.withColumn(out, make_key(as_text(df, column)))
    return df.filter(F.col(out).isNotNull()) if drop_missing else df


def _per_key(df: DataFrame, key: str, name: str, extra: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(extra or []), key).agg(F.count(F.lit(1)).alias(name))


def side(left: Column, right: Column) -> Column:
    return F.when(right.isNull(), "left_only").when(left.isNull(), "right_only").otherwise("both")


def compare_keys(left: DataFrame, right: DataFrame, key: str = "join_key") -> DataFrame:
    """One row per key of either side with its row counts and side."""
    both = _per_key(left, key, "left_rows").join(_per_key(right, key, "right_rows"), key, "full_outer")
    return both.withColumn("side", side(F.col("left_rows"), F.col("right_rows")))


def compare_counts(left: DataFrame, right: DataFrame, key: str = "join_key") -> DataFrame:
    """Per side: rows a full outer join would give (``pairs``), distinct keys, rows of each input."""
    rows_l, rows_r = F.coalesce("left_rows", F.lit(0)), F.coalesce("right_rows", F.lit(0))
    return (
        compare_keys(left, right, key).groupBy("side")
        .agg(
            F.sum(F.greatest(rows_l, F.lit(1)) * F.greatest(rows_r, F.lit(1))).alias("pairs"),
            F.count(F.lit(1)).alias("keys"),
            F.sum(rows_l).alias("left_rows"), F.sum(rows_r).alias("right_rows"),
        )
    )


def side_counts(left: DataFrame, right: DataFrame, key: str = "join_key") -> DataFrame:
    """Rows of a full outer join per side, empty sides included."""
    pairs = F.greatest("left_rows", F.lit(1)) * F.greatest("right_rows", F.lit(1))
    counts = [F.coalesce(F.sum(F.when(F.col("side") == s, pairs)), F.lit(0)).alias(s)
              for s in ("both", "left_only", "right_only")]
    return _as_rows(compare_keys(left, right, key).agg(*counts), "side", "rows")


def compare_counts_by_flag(left: DataFrame, right: DataFrame, flag: str, values: list[str],
                           key: str = "join_key") -> DataFrame:
    """:func:`compare_counts` for every flag value in one pass: the left rows of that value against
    the whole right side."""
    per_flag = [F.count_if(q(flag) == v).alias(f"left_{v}") for v in values]
    both = left.groupBy(key).agg(*per_flag).join(_per_key(right, key, "right_rows"), key, "full_outer")
    rows_r = F.coalesce("right_rows", F.lit(0))
    parts = F.array(*[
        F.struct(F.lit(v).alias("flag"), F.coalesce(F.col(f"left_{v}"), F.lit(0)).alias("l")) for v in values
    ])
    tagged = both.select(rows_r.alias("r"), F.explode(parts).alias("p")).select("r", "p.flag", "p.l")
    present = tagged.filter((F.col("l") > 0) | (F.col("r") > 0))
    named = F.when(F.col("r") == 0, "left_only").when(F.col("l") == 0, "right_only").otherwise("both")
    return (
        present.withColumn("side", named).groupBy("flag", "side")
        .agg(F.sum(F.greatest("l", F.lit(1)) * F.greatest("r", F.lit(1))).alias("pairs"),
             F.count(F.lit(1)).alias("keys"))
    )


def compare_rows(left: DataFrame, right: DataFrame, key: str = "join_key") -> DataFrame:
    """Rows of both inputs with their side and the number of partners, each row once.

    Left rows come as 'both' or 'left_only', right rows without partner as 'right_only'. The other
    input is reduced to a count per key first, so a hot key is not multiplied.
    """
    l = attach(left, _per_key(right, key, "partners"), key)
    l = l.withColumn("side", F.when(F.col("partners").isNull(), "left_only").otherwise("both"))
    r = attach(right, left.select(key).distinct(), key, how="left_anti").withColumn("side", F.lit("right_only"))
    return l.unionByName(r, allowMissingColumns=True).withColumn("partners", F.coalesce("partners", F.lit(0)))


def overlap_rows(left: DataFrame, right: DataFrame, columns: list[str], key: str = "join_key") -> DataFrame:
    """Distinct left rows (of ``columns``) whose key occurs on the right."""
    return select_present(attach(left, right.select(key).distinct(), key, how="left_semi"), columns).distinct()


def only_left(left: DataFrame, right: DataFrame, key: str = "join_key", keep_missing: bool = True) -> DataFrame:
    """Left rows without partner. Rows with a missing key stay unless ``keep_missing`` is false."""
    if not keep_missing:
        left = left.filter(q(key).isNotNull())
    return attach(left, right.select(key).distinct(), key, how="left_anti")


def list_counts(left: DataFrame, right: DataFrame, flag: str, key: str = "join_key") -> DataFrame:
    """Two-list summary: rows of each list, overlap pairs, rows of one list only, flagged left rows."""
    l = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"), F.count_if(q(flag) == "Y").alias("y"))
    both = l.join(_per_key(right, key, "r"), key, "full_outer")
    n_l, n_r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    return both.agg(
        F.sum(n_l).alias("left_rows"), F.sum(n_r).alias("right_rows"), F.sum(n_l * n_r).alias("overlap_pairs"),
        F.sum(F.when(n_r == 0, n_l).otherwise(0)).alias("left_only"),
        F.sum(F.when(n_l == 0, n_r).otherwise(0)).alias("right_only"),
        F.sum(F.coalesce("y", F.lit(0))).alias("left_flagged"),
    )


def reconcile_tables(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Two-table reconciliation on a unique key: per key its outcome and the columns that differ.

    Outcomes: match, mismatch, missing_left, missing_right. Nulls on both sides are equal.
    """
    l = left.select(q(key), F.lit(True).alias("__l"), *[q(v).alias(f"left_{v}") for v in values])
    r = right.select(q(key), F.lit(True).alias("__r"), *[q(v).alias(f"right_{v}") for v in values])
    differing = F.filter(
        F.array(*[F.when(~q(f"left_{v}").eqNullSafe(q(f"right_{v}")), F.lit(v)) for v in values]),
        lambda x: x.isNotNull(),
    )
    outcome = (
        F.when(F.col("__l").isNull(), "missing_left").when(F.col("__r").isNull(), "missing_right")
        .when(F.size(differing) > 0, "mismatch").otherwise("match")
    )
    joined = l.join(r, key, "full_outer").withColumns({"outcome": outcome, "differing": differing})
    return joined.drop("__l", "__r")


def reconcile_report(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


# --- set overlaps -----------------------------------------------------------------------------

def memberships(sets: dict[str, DataFrame], key: str = "join_key") -> DataFrame:
    """One row per distinct key with one boolean per set."""
    tagged = [df.select(q(key).alias("key"), *[F.lit(n == m).alias(m) for m in sets]) for n, df in sets.items()]
    every = reduce(DataFrame.unionByName, tagged).filter(F.col("key").isNotNull())
    return every.groupBy("key").agg(*[F.bool_or(m).alias(m) for m in sets])


def venn_regions(sets: dict[str, DataFrame], key: str = "join_key") -> DataFrame:
    """Exact sizes of all regions of a Venn diagram, empty regions included (``region`` lists the sets)."""
    names = list(sets)
    members = memberships(sets, key)
    masks = [[n for i, n in enumerate(names) if b >> i & 1] for b in range(1, 2 ** len(names))]
    counts = [
        F.count_if(reduce(lambda a, b: a & b, [F.col(n) if n in m else ~F.col(n) for n in names])).alias("+".join(m))
        for m in masks
    ]
    return _as_rows(members.agg(*counts), "region", "keys")


def _as_rows(one_row: DataFrame, name: str, value: str) -> DataFrame:
    return one_row.unpivot([], [q(c) for c in one_row.columns], name, value)


def set_sizes(sets: dict[str, DataFrame], key: str = "join_key") -> DataFrame:
    """One row: size of each of three sets, of each pair overlap and of the triple overlap."""
    a, b, c = sets
    flag = F.col
    return memberships(sets, key).agg(
        *[F.count_if(flag(n)).alias(n) for n in (a, b, c)],
        F.count_if(flag(a) & flag(b)).alias(f"{a}_{b}"), F.count_if(flag(a) & flag(c)).alias(f"{a}_{c}"),
        F.count_if(flag(b) & flag(c)).alias(f"{b}_{c}"), F.count_if(flag(a) & flag(b) & flag(c)).alias("all_three"),
    )


def venn_from_sizes(sizes: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Regions from set and overlap sizes by inclusion and exclusion, never below zero."""
    n = F.col
    ab, ac, bc, abc = n(f"{a}_{b}"), n(f"{a}_{c}"), n(f"{b}_{c}"), n("all_three")
    regions = {
        a: n(a) - ab - ac + abc, b: n(b) - ab - bc + abc, c: n(c) - ac - bc + abc,
        f"{a}+{b}": ab - abc, f"{a}+{c}": ac - abc, f"{b}+{c}": bc - abc, f"{a}+{b}+{c}": abc,
    }
    return _as_rows(sizes.select(*[F.greatest(v, F.lit(0)).alias(k) for k, v in regions.items()]), "region", "keys")


def overlap_statistics(scored: DataFrame, listed: DataFrame, percent: str, key: str = "join_key",
                       upper: float = FLAG_AT, lower: float = 30) -> DataFrame:
    """Overlap of the list with companies at or above ``upper`` and with those from ``lower`` up to it.

    Row counts and key counts are reported apart; counts of keys are exact set sizes.
    """
    p = q(percent)
    high, mid = p >= upper, (p >= lower) & (p < upper)
    s = scored.groupBy(key).agg(F.count_if(high).alias("high"), F.count_if(mid).alias("mid"))
    both = s.join(_per_key(listed, key, "listed"), key, "full_outer")
    n_high, n_mid, n_list = (F.coalesce(c, F.lit(0)) for c in ("high", "mid", "listed"))
    return both.agg(
        F.sum(n_high).alias("pure_play_rows"), F.sum(n_list).alias("list_rows"), F.sum(n_mid).alias("near_rows"),
        F.count_if((n_high > 0) & (n_list > 0)).alias("pure_play_in_list"),
        F.count_if((n_high > 0) & (n_list == 0)).alias("pure_play_not_in_list"),
        F.count_if((n_high == 0) & (n_list > 0)).alias("list_not_in_pure_play"),
        F.count_if((n_mid > 0) & (n_list > 0)).alias("near_in_list"),
    )


def scope_overlaps(in_scope: DataFrame, register: DataFrame, eligible: Column, client: Column,
                   key: str = "company_number") -> DataFrame:
    """In-scope, eligible and client companies: rows of each, and exact set sizes of all regions.

    One row per measure. Facility fan-out multiplies register rows, so rows and sets differ;
    the regions are those of the distinct keys and never negative.
    """
    r = register.groupBy(q(key).alias("key")).agg(
        F.count_if(eligible).alias("eligible"), F.count_if(client).alias("client"))
    s = in_scope.groupBy(q(key).alias("key")).agg(F.count(F.lit(1)).alias("scope"))
    both = s.join(r, "key", "full_outer")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("scope", "eligible", "client")}
    has = {c: (v > 0) & F.col("key").isNotNull() for c, v in n.items()}
    names = list(n)
    out = [F.sum(v).alias(f"rows_{c}") for c, v in n.items()]
    for b in range(1, 8):
        inside = [c for i, c in enumerate(names) if b >> i & 1]
        test = reduce(lambda x, y: x & y, [has[c] if c in inside else ~has[c] for c in names])
        out.append(F.count_if(test).alias("keys_" + "_".join(inside)))
    return _as_rows(both.agg(*out), "measure", "value")


def flag_mix(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(q(flag) == "Y").alias("yes"),
                  F.count_if(q(flag) == "N").alias("no"))

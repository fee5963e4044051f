"""Registered queries: company reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import keys
from ..functions.numbers import number_from_thousands, to_number, threshold_flag, to_number
from ..operators import digests, filters, measures, ranking, reconcile, schema
from ..registry import query, table
from ..sources import sinks
from .inputs import (COUNTERPARTIES, MATCHED_COLUMNS, SCORES, WATCH_LIST, counterparties, scores, sql_key, sql_matched,
                     sql_strip, sql_with, watch_list)


def matched(spark, sf: str, how: str = "inner") -> DataFrame:
    s = scores(spark, sf)
    s = s.withColumn("totalRevenue", number_from_thousands(F.col("totalRevenue")))
    return reconcile.match_scores(counterparties(spark, sf), s, how)


def matched_keyed(spark, sf: str) -> DataFrame:
    return reconcile.keyed(matched(spark, sf), "counterparty_id")


def listed_keyed(spark, sf: str) -> DataFrame:
    return reconcile.keyed(watch_list(spark, sf), "SDS")


MATCHED = sql_matched()
KEYED = f"""gr AS (SELECT *, {sql_key('counterparty_id')} AS k FROM matched),
wl AS (SELECT *, {sql_key('"SDS"')} AS k FROM watch_list)"""
PAIR = sql_with(MATCHED, WATCH_LIST, KEYED)


@query("jon1_green_revenue", sql_with(MATCHED) + f"SELECT {MATCHED_COLUMNS} FROM matched")
def jon1(spark, sf):
    return matched(spark, sf)


@query("jon2_green_revenue_left", sql_with(sql_matched("LEFT JOIN")) + f"SELECT {MATCHED_COLUMNS} FROM matched")
def jon2(spark, sf):
    return matched(spark, sf, "left")


@query("jon8_compare_sides", PAIR + """, y AS (SELECT * FROM gr WHERE pure_play_flag = 'Y'),
l AS (SELECT k, count(*) AS lr FROM y GROUP BY k), r AS (SELECT k, count(*) AS rr FROM wl GROUP BY k)
SELECT CASE WHEN lr IS NULL THEN 'right_only' WHEN rr IS NULL THEN 'left_only' ELSE 'both' END AS side,
       sum(coalesce(lr, 1) * coalesce(rr, 1))::BIGINT AS pairs, count(*) AS keys,
       sum(coalesce(lr, 0))::BIGINT AS left_rows, sum(coalesce(rr, 0))::BIGINT AS right_rows
FROM l FULL JOIN r ON l.k = r.k GROUP BY 1""")
def jon8(spark, sf):
    y = matched_keyed(spark, sf).filter(F.col("pure_play_flag") == "Y")
    return reconcile.compare_counts(y, listed_keyed(spark, sf))


@query("jon8_compare_rows", PAIR + """, y AS (SELECT * FROM gr WHERE pure_play_flag = 'Y')
SELECT y.counterparty_id, y.year, NULL AS client, y.k AS join_key,
       CASE WHEN n IS NULL THEN 'left_only' ELSE 'both' END AS side, coalesce(n, 0) AS partners
FROM y LEFT JOIN (SELECT k, count(*) AS n FROM wl GROUP BY k) r ON y.k = r.k
UNION ALL
SELECT NULL, NULL, "Client Name", k, 'right_only', 0 FROM wl WHERE k NOT IN (SELECT k FROM y)""")
def jon8_rows(spark, sf):
    y = matched_keyed(spark, sf).filter(F.col("pure_play_flag") == "Y").select("counterparty_id", "year", "join_key")
    r = listed_keyed(spark, sf).select(F.col("Client Name").alias("client"), "join_key")
    return reconcile.compare_rows(y, r).select("counterparty_id", "year", "client", "join_key", "side", "partners")


@query("jon9_overlap_distinct", PAIR + """SELECT DISTINCT counterparty_id, counterparty_name, country_code
FROM gr WHERE k IN (SELECT k FROM wl)""")
def jon9(spark, sf):
    return reconcile.overlap_rows(matched_keyed(spark, sf), listed_keyed(spark, sf),
                                  ["counterparty_id", "counterparty_name", "country_code"])


@query("jon10_only_in_either", PAIR + """SELECT 'matched' AS list, counterparty_id AS id FROM gr WHERE k NOT IN (SELECT k FROM wl)
UNION ALL SELECT 'watch', "SDS" FROM wl WHERE k NOT IN (SELECT k FROM gr)""")
def jon10(spark, sf):
    g, w = matched_keyed(spark, sf), listed_keyed(spark, sf)
    return reconcile.only_left(g, w).select(F.lit("matched").alias("list"), F.col("counterparty_id").alias("id")).union(
        reconcile.only_left(w, g).select(F.lit("watch"), F.col("SDS")))


@query("jon11_unscored_counterparties", sql_with(COUNTERPARTIES, SCORES) + f"""SELECT counterparty_id, counterparty_name
FROM counterparties c LEFT JOIN (SELECT DISTINCT {sql_key('"companyName"')} AS k FROM scores WHERE "greenRevenuePercent" >= 50) s
  ON {sql_key('c.counterparty_name')} = s.k WHERE s.k IS NULL""")
def jon11(spark, sf):
    c = reconcile.keyed(counterparties(spark, sf), "counterparty_name")
    s = reconcile.keyed(scores(spark, sf).filter(to_number(F.col("greenRevenuePercent")) >= reconcile.FLAG_AT), "companyName")
    return reconcile.only_left(c, s).select("counterparty_id", "counterparty_name")


@query("jon13_compare_by_flag", PAIR + """, f AS (SELECT unnest(['Y', 'N']) AS flag),
l AS (SELECT pure_play_flag AS flag, k, count(*) AS lr FROM gr GROUP BY ALL),
r AS (SELECT flag, k, count(*) AS rr FROM wl, f GROUP BY ALL)
SELECT coalesce(l.flag, r.flag) AS flag,
       CASE WHEN lr IS NULL THEN 'right_only' WHEN rr IS NULL THEN 'left_only' ELSE 'both' END AS side,
       sum(coalesce(lr, 1) * coalesce(rr, 1))::BIGINT AS pairs, count(*) AS keys
FROM l FULL JOIN r ON l.k = r.k AND l.flag = r.flag GROUP BY 1, 2""")
def jon13(spark, sf):
    return reconcile.compare_counts_by_flag(matched_keyed(spark, sf), listed_keyed(spark, sf), "pure_play_flag", ["Y", "N"])


RECONCILED = """a AS (SELECT o_orderkey AS id, o_totalprice AS value, o_orderpriority AS label FROM orders WHERE o_orderkey % 97 <> 0),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value,
        CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_orderpriority END AS label FROM orders WHERE o_orderkey % 89 <> 0),
rec AS (SELECT coalesce(a.id, b.id) AS id, a.value AS left_value, b.value AS right_value, a.label AS left_label, b.label AS right_label,
    CASE WHEN a.id IS NULL THEN 'missing_left' WHEN b.id IS NULL THEN 'missing_right'
         WHEN a.value IS DISTINCT FROM b.value OR a.label IS DISTINCT FROM b.label THEN 'mismatch' ELSE 'match' END AS outcome,
    concat_ws(',', CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value' END, CASE WHEN a.label IS DISTINCT FROM b.label THEN 'label' END) AS differing
  FROM a FULL JOIN b ON a.id = b.id)"""


def reconciled(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    a = o.filter(key % 97 != 0).select(key.alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("label"))
    b = o.filter(key % 89 != 0).select(
        key.alias("id"), F.when(key % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("value"),
        F.when(key % 15 != 0, F.col("o_orderpriority")).alias("label"))
    return reconcile.reconcile_tables(a, b, "id", ["value", "label"])


@query("jon15_reconcile_rows", sql_with(RECONCILED) + "SELECT id, round(left_value, 2) AS left_value, round(right_value, 2) AS right_value, left_label, right_label, outcome, differing FROM rec")
def jon15(spark, sf):
    return reconciled(spark, sf).select("id", F.round("left_value", 2).alias("left_value"),
                                        F.round("right_value", 2).alias("right_value"), "left_label", "right_label", "outcome",
                                        F.array_join("differing", ",").alias("differing"))


@query("jon15_reconcile_report", sql_with(RECONCILED) + "SELECT outcome, count(*) AS records FROM rec GROUP BY outcome")
def jon15_report(spark, sf):
    return reconcile.reconcile_report(reconciled(spark, sf))


# A copy in which one row of a hundred differs, some are gone and some are new: reconciled by bucket digests.
COPIED = """a AS (SELECT o_orderkey AS id, o_totalprice AS value, o_orderpriority AS label FROM orders WHERE o_orderkey % 997 <> 0),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value,
        CASE WHEN o_orderkey % 1500 = 0 THEN NULL ELSE o_orderpriority END AS label FROM orders WHERE o_orderkey % 991 <> 0),""" + RECONCILED[RECONCILED.index("\nrec AS"):]


def copied(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    a = o.filter(key % 997 != 0).select(key.alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("label"))
    b = o.filter(key % 991 != 0).select(
        key.alias("id"), F.when(key % 100 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("value"),
        F.when(key % 1500 != 0, F.col("o_orderpriority")).alias("label"))
    return a, b


@query("jon15_digest_rows", sql_with(COPIED) + "SELECT id, round(left_value, 2) AS left_value, round(right_value, 2) AS right_value, left_label, right_label, outcome, differing FROM rec")
def jon15_digest_rows(spark, sf):
    found = digests.reconcile_by_digests(*copied(spark, sf), "id", ["value", "label"])
    return found.select("id", F.round("left_value", 2).alias("left_value"), F.round("right_value", 2).alias("right_value"),
                        "left_label", "right_label", "outcome", F.array_join("differing", ",").alias("differing"))


@query("jon15_digest_report", sql_with(COPIED) + "SELECT outcome, count(*) AS records FROM rec GROUP BY outcome")
def jon15_digest_report(spark, sf):
    return digests.report_by_digests(*copied(spark, sf), "id", ["value", "label"])


# --- keys ---------------------------------------------------------------------------------------

@query("key1_basic", sql_with(SCORES) + f"""SELECT "companyName" AS raw, lower({sql_strip('"companyName"')}) AS key, year FROM scores""")
def key1(spark, sf):
    return scores(spark, sf).select(F.col("companyName").alias("raw"), keys.basic_key(F.col("companyName")).alias("key"), "year")


@query("key2_robust", sql_with(WATCH_LIST) + f"""SELECT "SDS" AS raw, {sql_key('"SDS"')} AS key FROM watch_list""")
def key2(spark, sf):
    return watch_list(spark, sf).select(F.col("SDS").alias("raw"), keys.robust_key(F.col("SDS")).alias("key"))


@query("key2_numeric_ids", "SELECT o_orderkey AS id, o_orderkey::VARCHAR AS key FROM orders")
def key2_numeric(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("double").alias("raw"))
    return d.select("id", keys.robust_key(keys.as_text(d, "raw")).alias("key"))


@query("key3_unpadded", "SELECT s_suppkey AS id, lower(ltrim('000' || s_suppkey || 'A', '0')) AS key FROM supplier")
def key3(spark, sf):
    padded = F.concat(F.lit(" 000"), F.col("s_suppkey").cast("string"), F.lit("A\t"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), keys.unpadded_key(padded).alias("key"))


@query("key4_lower", "SELECT p_partkey AS id, lower(p_brand) AS key FROM part")
def key4(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), keys.lower_key(F.col("p_brand")).alias("key"))


@query("key5_code", sql_with(COUNTERPARTIES) + f"SELECT counterparty_id AS id, upper({sql_strip('country_code')}) AS key FROM counterparties")
def key5(spark, sf):
    return counterparties(spark, sf).select(F.col("counterparty_id").alias("id"), keys.code_key(F.col("country_code")).alias("key"))


@query("key6_several_keys", sql_with(WATCH_LIST) + f"""SELECT "SDS" AS id, lower({sql_strip('"Client Name"')}) AS name_key,
  lower({sql_strip('"SDS"')}) AS id_key, lower("BIC") AS bic_key FROM watch_list""")
def key6(spark, sf):
    k = keys.with_keys(watch_list(spark, sf), {"name_key": "Client Name", "id_key": "SDS", "bic_key": "BIC", "tln_key": "TLN"},
                       keys.basic_key)
    return k.select(F.col("SDS").alias("id"), "name_key", "id_key", "bic_key")


# --- sets ---------------------------------------------------------------------------------------

def three_sets(spark, sf):
    b = lambda df, c: df.select(keys.basic_key(F.col(c)).alias("join_key"))
    high = reconcile.match_scores(counterparties(spark, sf), scores(spark, sf)).filter(F.col("pure_play_flag") == "Y")
    part = counterparties(spark, sf).filter(F.col("counterparty_id").cast("bigint") % 3 != 0)
    return {"a": b(part, "counterparty_name"), "b": b(high, "counterparty_name"),
            "c": b(watch_list(spark, sf), "Client Name")}


THREE_SETS = f"""a AS (SELECT DISTINCT lower({sql_strip('counterparty_name')}) AS k FROM counterparties WHERE counterparty_id::BIGINT % 3 <> 0),
b AS (SELECT DISTINCT lower({sql_strip('counterparty_name')}) AS k FROM matched WHERE pure_play_flag = 'Y'),
c AS (SELECT DISTINCT lower({sql_strip('"Client Name"')}) AS k FROM watch_list),
m AS (SELECT coalesce(ab.k, c.k) AS k, coalesce(ina, false) AS ina, coalesce(inb, false) AS inb, c.k IS NOT NULL AS inc
  FROM (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS ina, b.k IS NOT NULL AS inb FROM a FULL JOIN b ON a.k = b.k) ab
  FULL JOIN c ON ab.k = c.k)"""
VENN = """SELECT region, (SELECT count(*) FROM m WHERE ina = x AND inb = y AND inc = z) AS keys
FROM (VALUES ('a', true, false, false), ('b', false, true, false), ('a+b', true, true, false), ('c', false, false, true),
             ('a+c', true, false, true), ('b+c', false, true, true), ('a+b+c', true, true, true)) t(region, x, y, z)"""


@query("set3_venn_regions", sql_with(MATCHED, WATCH_LIST, THREE_SETS) + VENN)
def set3(spark, sf):
    return reconcile.venn_regions(three_sets(spark, sf))


@query("set4_venn_from_sizes", sql_with(MATCHED, WATCH_LIST, THREE_SETS) + VENN)
def set4(spark, sf):
    return reconcile.venn_from_sizes(reconcile.set_sizes(three_sets(spark, sf)), "a", "b", "c")


@query("set5_overlap_statistics", PAIR + """, hi AS (SELECT k FROM gr WHERE "greenRevenuePercent" >= 50),
mid AS (SELECT k FROM gr WHERE "greenRevenuePercent" >= 30 AND "greenRevenuePercent" < 50)
SELECT (SELECT count(*) FROM hi) AS pure_play_rows, (SELECT count(*) FROM wl) AS list_rows, (SELECT count(*) FROM mid) AS near_rows,
  (SELECT count(DISTINCT k) FROM hi WHERE k IN (SELECT k FROM wl)) AS pure_play_in_list,
  (SELECT count(DISTINCT k) FROM hi WHERE k NOT IN (SELECT k FROM wl)) AS pure_play_not_in_list,
  (SELECT count(DISTINCT k) FROM wl WHERE k NOT IN (SELECT k FROM hi)) AS list_not_in_pure_play,
  (SELECT count(DISTINCT k) FROM mid WHERE k IN (SELECT k FROM wl)) AS near_in_list""")
def set5(spark, sf):
    return reconcile.overlap_statistics(matched_keyed(spark, sf), listed_keyed(spark, sf), "greenRevenuePercent")


@query("set7_list_counts", PAIR + """SELECT (SELECT count(*) FROM gr) AS left_rows, (SELECT count(*) FROM wl) AS right_rows,
  (SELECT count(*) FROM gr JOIN wl ON gr.k = wl.k) AS overlap_pairs,
  (SELECT count(*) FROM gr WHERE k NOT IN (SELECT k FROM wl)) AS left_only,
  (SELECT count(*) FROM wl WHERE k NOT IN (SELECT k FROM gr)) AS right_only,
  (SELECT count(*) FROM gr WHERE pure_play_flag = 'Y') AS left_flagged""")
def set7(spark, sf):
    return reconcile.list_counts(matched_keyed(spark, sf), listed_keyed(spark, sf), "pure_play_flag")


@query("agg26_side_counts", PAIR + """SELECT 'both' AS side, count(*) AS rows FROM gr JOIN wl ON gr.k = wl.k
UNION ALL SELECT 'left_only', count(*) FROM gr WHERE k NOT IN (SELECT k FROM wl)
UNION ALL SELECT 'right_only', count(*) FROM wl WHERE k NOT IN (SELECT k FROM gr)""")
def agg26(spark, sf):
    return reconcile.side_counts(matched_keyed(spark, sf), listed_keyed(spark, sf))


@query("agg27_flag_mix", sql_with(MATCHED) + """SELECT count(*) AS total, count(*) FILTER (pure_play_flag = 'Y') AS yes,
count(*) FILTER (pure_play_flag = 'N') AS no FROM matched""")
def agg27(spark, sf):
    return reconcile.flag_mix(matched(spark, sf), "pure_play_flag")


@query("minimum_slice", PAIR + """, f AS (SELECT unnest(['Y', 'N']) AS flag),
l AS (SELECT pure_play_flag AS flag, k, count(*) AS lr FROM gr GROUP BY ALL),
r AS (SELECT flag, k, count(*) AS rr FROM wl, f GROUP BY ALL)
SELECT coalesce(l.flag, r.flag) AS flag,
       CASE WHEN lr IS NULL THEN 'right_only' WHEN rr IS NULL THEN 'left_only' ELSE 'both' END AS side,
       sum(coalesce(lr, 1) * coalesce(rr, 1))::BIGINT AS count
FROM l FULL JOIN r ON l.k = r.k AND l.flag = r.flag GROUP BY 1, 2""")
def minimum_slice(spark, sf):
    return jon13(spark, sf).select("flag", "side", F.col("pairs").alias("count"))


# --- aggregates of the joined set ---------------------------------------------------------------

@query("agg3_top_categories", sql_with(MATCHED) + """SELECT country_code, count(*) AS rows FROM matched
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def agg3(spark, sf):
    return measures.top_categories(matched(spark, sf), "country_code", 10)


@query("agg4_flag_distribution", sql_with(MATCHED) + "SELECT pure_play_flag, count(*) AS rows FROM matched GROUP BY 1")
def agg4(spark, sf):
    return measures.count_by(matched(spark, sf), "pure_play_flag").orderBy(F.desc("rows"))


@query("agg5_count_by_two", sql_with(MATCHED) + "SELECT year, pure_play_flag, count(*) AS rows FROM matched GROUP BY 1, 2")
def agg5(spark, sf):
    return measures.count_by(matched(spark, sf), "year", "pure_play_flag")


@query("agg6_sum_by", sql_with(MATCHED) + """SELECT country_code, round(sum("totalRevenue"), 2) AS total FROM matched GROUP BY 1""")
def agg6(spark, sf):
    return measures.sum_by(matched(spark, sf), ["country_code"], "totalRevenue").withColumn("total", F.round("total", 2))


@query("agg7_top_by_sum", sql_with(MATCHED) + """SELECT group_name, round(sum("totalRevenue"), 2) AS total FROM matched
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def agg7(spark, sf):
    return measures.top_by_sum(matched(spark, sf), "group_name", "totalRevenue").withColumn("total", F.round("total", 2))


@query("agg8_mean_by", sql_with(MATCHED) + """SELECT country_code, round(avg("greenRevenuePercent"), 4) AS mean FROM matched GROUP BY 1""")
def agg8(spark, sf):
    return measures.mean_by(matched(spark, sf), "country_code", "greenRevenuePercent").withColumn("mean", F.round("mean", 4))


@query("agg9_country_profile", sql_with(MATCHED) + f"""SELECT upper({sql_strip('country_code')}) AS country,
count(DISTINCT counterparty_id) AS distinct_ids, round(avg("greenRevenuePercent"), 4) AS mean FROM matched GROUP BY 1""")
def agg9(spark, sf):
    m = matched(spark, sf)
    return measures.distinct_and_mean_by(m, keys.code_key(F.col("country_code")), "country", "counterparty_id",
                                         "greenRevenuePercent").withColumn("mean", F.round("mean", 4))


@query("agg10_sector_profile", sql_with(COUNTERPARTIES, SCORES, f"""m AS (
  SELECT s.naics_code[1:2] AS p, {sql_key('"companyName"')} AS id, "greenRevenuePercent" AS pct,
         CASE WHEN "greenRevenuePercent" >= 50 THEN 'Y' ELSE 'N' END AS flag FROM scores s),
lab AS (SELECT *, CASE WHEN p = '11' THEN 'Agriculture' WHEN p = '21' THEN 'Mining' WHEN p = '22' THEN 'Utilities'
  WHEN p = '23' THEN 'Construction' WHEN p IN ('31', '32', '33') THEN 'Manufacturing' WHEN p = '42' THEN 'Wholesale'
  WHEN p IN ('44', '45') THEN 'Retail' WHEN p IN ('48', '49') THEN 'Transport' WHEN p = '51' THEN 'Information'
  WHEN p = '52' THEN 'Finance' WHEN p = '53' THEN 'Real Estate' WHEN p = '54' THEN 'Professional' WHEN p = '56' THEN 'Admin'
  WHEN p = '61' THEN 'Education' WHEN p = '62' THEN 'Healthcare' WHEN p = '71' THEN 'Arts' WHEN p = '72' THEN 'Hospitality'
  WHEN p = '81' THEN 'Services' END AS sector FROM m)""") + """
SELECT sector, count(DISTINCT id) AS companies, round(avg(pct), 4) AS mean_percent, count(*) FILTER (flag = 'Y') AS flagged_rows,
  round(100.0 * count(DISTINCT id) FILTER (flag = 'Y') / count(DISTINCT id), 4) AS flagged_share,
  round(100.0 * count(*) FILTER (flag = 'Y') / count(DISTINCT id), 4) AS flagged_rows_share
FROM lab WHERE sector IS NOT NULL GROUP BY 1""")
def agg10(spark, sf):
    s = scores(spark, sf)
    s = s.withColumns({"pct": F.col("greenRevenuePercent").try_cast("double"), "id": keys.robust_key(F.col("companyName"))})
    s = measures.flag_at(s, "pct", "flag", 50)
    p = measures.sector_profile(s, "naics_code", "id", "pct", "flag")
    return p.withColumns({c: F.round(c, 4) for c in ("mean_percent", "flagged_share", "flagged_rows_share")})


@query("agg15_histogram", sql_with(MATCHED) + """SELECT least(floor("greenRevenuePercent" / 5), 19)::BIGINT AS bin, count(*) AS rows,
least(floor("greenRevenuePercent" / 5), 19) * 5.0 AS bin_from, least(floor("greenRevenuePercent" / 5), 19) * 5.0 + 5 AS bin_to
FROM matched WHERE "greenRevenuePercent" BETWEEN 0 AND 100 GROUP BY ALL""")
def agg15(spark, sf):
    return measures.histogram(matched(spark, sf), "greenRevenuePercent", 20, 0.0, 100.0)


@query("agg15_histogram_by_flag", sql_with(MATCHED) + """SELECT pure_play_flag, least(floor("greenRevenuePercent" / 10), 9)::BIGINT AS bin,
count(*) AS rows FROM matched WHERE "greenRevenuePercent" BETWEEN 0 AND 100 GROUP BY ALL""")
def agg15_flag(spark, sf):
    return measures.histogram(matched(spark, sf), "greenRevenuePercent", 10, 0.0, 100.0, ["pure_play_flag"]).select(
        "pure_play_flag", "bin", "rows")


@query("agg16_box_statistics", sql_with(MATCHED) + """, quart AS (SELECT pure_play_flag AS f, quantile_cont("greenRevenuePercent", 0.25) AS q1,
  quantile_cont("greenRevenuePercent", 0.5) AS median, quantile_cont("greenRevenuePercent", 0.75) AS q3 FROM matched GROUP BY 1)
SELECT pure_play_flag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min("greenRevenuePercent") AS min,
  max("greenRevenuePercent") AS max,
  min("greenRevenuePercent") FILTER ("greenRevenuePercent" >= q1 - 1.5 * (q3 - q1) AND "greenRevenuePercent" <= q3 + 1.5 * (q3 - q1)) AS lower_fence,
  max("greenRevenuePercent") FILTER ("greenRevenuePercent" >= q1 - 1.5 * (q3 - q1) AND "greenRevenuePercent" <= q3 + 1.5 * (q3 - q1)) AS upper_fence
FROM matched JOIN quart ON pure_play_flag = f WHERE "greenRevenuePercent" IS NOT NULL GROUP BY pure_play_flag, q1, median, q3""")
def agg16(spark, sf):
    rows = sinks.materialise(matched(spark, sf).select("pure_play_flag", "greenRevenuePercent"), "matched")
    b = measures.box_statistics(rows, ["pure_play_flag"], "greenRevenuePercent")
    return b.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("agg17_range_counts", sql_with(MATCHED) + """, r(position, label, lo, hi) AS (VALUES (1, '<1M', 0, 1e6), (2, '1M-10M', 1e6, 1e7),
(3, '10M-100M', 1e7, 1e8), (4, '100M-1B', 1e8, 1e9), (5, '1B-10B', 1e9, 1e10), (6, '>10B', 1e10, 1e300))
SELECT position, label, (SELECT count(*) FROM matched WHERE pure_play_flag = 'N' AND "totalRevenue" > lo AND "totalRevenue" <= hi) AS rows FROM r""")
def agg17(spark, sf):
    return measures.range_counts(matched(spark, sf).filter(F.col("pure_play_flag") == "N"), "totalRevenue")


@query("agg18_density", sql_with(MATCHED) + """, s AS (SELECT count("greenRevenuePercent") AS n, stddev_samp("greenRevenuePercent") * pow(count("greenRevenuePercent"), -0.2) AS h FROM matched)
SELECT x::DOUBLE AS x, round((SELECT sum(exp(-pow((x - "greenRevenuePercent") / h, 2) / 2) / (n * h * sqrt(2 * pi()))) FROM matched, s), 8) AS density
FROM (SELECT unnest(range(0, 101, 5)) AS x)""")
def agg18(spark, sf):
    rows = sinks.materialise(matched(spark, sf).select("greenRevenuePercent"), "matched")
    return measures.density(rows, "greenRevenuePercent", [float(x) for x in range(0, 101, 5)]).withColumn(
        "density", F.round("density", 8))


# --- distinct and filters on the joined set -----------------------------------------------------

@query("win4_distinct_projection", sql_with(MATCHED) + "SELECT DISTINCT country_code, bic_code FROM matched")
def win4(spark, sf):
    return ranking.distinct_rows(matched(spark, sf), ["country_code", "bic_code"])


@query("prj12_threshold_flag", sql_with(SCORES) + """SELECT "companyName", year, CASE WHEN "greenRevenuePercent" >= 50 THEN 'Y' ELSE 'N' END AS flag FROM scores""")
def prj12(spark, sf):
    return scores(spark, sf).select("companyName", "year", threshold_flag(to_number(F.col("greenRevenuePercent"))).alias("flag"))


@query("prj9_thousands", sql_with(SCORES) + """SELECT "companyName", year, "totalRevenue" AS revenue FROM scores""")
def prj9(spark, sf):
    return scores(spark, sf).select("companyName", "year", number_from_thousands(F.col("totalRevenue")).alias("revenue"))


@query("prj8_to_number", sql_with(SCORES) + """SELECT "companyName", year, "greenRevenuePercent" AS percent FROM scores""")
def prj8(spark, sf):
    return scores(spark, sf).select("companyName", "year", to_number(F.col("greenRevenuePercent")).alias("percent"))


@query("flt15_drop_missing", sql_with(MATCHED) + """SELECT counterparty_id, year, "greenRevenuePercent" FROM matched WHERE "greenRevenuePercent" IS NOT NULL""")
def flt15(spark, sf):
    return filters.drop_missing(matched(spark, sf), ["greenRevenuePercent"]).select("counterparty_id", "year", "greenRevenuePercent")


@query("prj1_select_present", sql_with(COUNTERPARTIES) + "SELECT counterparty_id, group_name FROM counterparties")
def prj1(spark, sf):
    return schema.select_present(counterparties(spark, sf), ["counterparty_id", "naics_code", "group_name"])

"""Registered queries: chart-ready aggregates, measures by dimensions, table transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import number_from_money
from ..operators import documents, filters, measures, ranking, schema, seasonal, transforms
from ..registry import query, table
from ..sources import sinks
from .inputs import FILE_PATHS, file_paths, sql_with
from ..operators.catalogue import with_path_tags


def measure_rows(spark, sf):
    """Lineitems with their order: the fact table of the measure questions, with scenario and run."""
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "baseline").otherwise("adverse").alias("scenario"),
        F.concat(F.lit("run"), F.lpad(F.month("o_orderdate").cast("string"), 3, "0")).alias("run_id"))


MEASURES = """m AS (SELECT l_returnflag, l_linestatus, l_extendedprice, l_quantity, o_orderpriority,
  CASE WHEN o_orderstatus = 'F' THEN 'baseline' ELSE 'adverse' END AS scenario,
  'run' || lpad(month(o_orderdate)::VARCHAR, 3, '0') AS run_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def rounded(df, *columns, digits=2):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("agg22_measure_by", sql_with(MEASURES) + """SELECT l_linestatus, o_orderpriority, round(sum(l_extendedprice), 2) AS total_l_extendedprice
FROM m WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def agg22(spark, sf):
    return rounded(measures.measure_by(measure_rows(spark, sf), "l_extendedprice", ["l_linestatus", "o_orderpriority"],
                                       {"l_returnflag": "R"}), "total_l_extendedprice")


@query("agg22_measure_by_run", sql_with(MEASURES) + """SELECT run_id, l_returnflag, round(sum(l_extendedprice), 2) AS total_l_extendedprice
FROM m WHERE scenario = 'baseline' AND run_id IN ('run001', 'run004') GROUP BY 1, 2""")
def agg22_run(spark, sf):
    return rounded(measures.measure_by(measure_rows(spark, sf), "l_extendedprice", ["run_id", "l_returnflag"],
                                       scenario="baseline", run_ids=["run001", "run004"]), "total_l_extendedprice")


@query("agg22_recent_runs", sql_with(MEASURES) + """, runs AS (SELECT scenario, run_id, max(l_extendedprice) AS created FROM m GROUP BY 1, 2),
recent AS (SELECT scenario, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY created DESC, run_id) <= 4)
SELECT scenario, run_id, round(sum(l_extendedprice), 2) AS total_l_extendedprice, count(*) AS rows FROM m JOIN recent USING (scenario, run_id) GROUP BY 1, 2""")
def agg22_recent(spark, sf):
    """Partitioned folders by scenario and run, and a catalogue of the runs; the newest four runs of each scenario are
    found when the query runs and prune the scan. (The tables have no creation time; the highest price stands for it.)"""
    path = sinks.scratch(spark, "runs")
    measure_rows(spark, sf).hint("rebalance", "scenario", "run_id").write.partitionBy("scenario", "run_id").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    stored.groupBy("scenario", "run_id").agg(F.max("l_extendedprice").alias("created")).write.parquet(f"{path}/catalogue")
    found = filters.in_recent_runs(stored, spark.read.parquet(f"{path}/catalogue"), "created")
    totals = found.groupBy("scenario", "run_id").agg(F.sum("l_extendedprice").alias("total_l_extendedprice"), F.count("*").alias("rows"))
    return rounded(totals, "total_l_extendedprice")


@query("agg22_measure_total", "SELECT sum(l_quantity) AS total_l_quantity FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N'")
def agg22_total(spark, sf):
    return measures.measure_by(table(spark, sf, "lineitem"), "l_quantity", equals={"l_linestatus": "O", "l_returnflag": "N"})


@query("flt10_equal_to", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def flt10(spark, sf):
    return filters.equal_to(table(spark, sf, "orders"), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@query("flt12_in_runs", sql_with(MEASURES) + "SELECT scenario, run_id, count(*) AS rows FROM m WHERE scenario = 'adverse' AND run_id IN ('run002', 'run003', 'run005') GROUP BY 1, 2")
def flt12(spark, sf):
    return measures.count_by(filters.in_runs(measure_rows(spark, sf), "adverse", ["run002", "run003", "run005"]), "scenario", "run_id")


@query("flt_between_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'")
def flt_dates(spark, sf):
    return filters.between_dates(table(spark, sf, "orders"), "o_orderdate", "1997-01-01", "1998-01-01").select("o_orderkey")


@query("agg15_histogram_over_range", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT bin, round(lo + bin * (hi - lo) / 30, 4) AS bin_from, rows FROM (
  SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, lo, hi, count(*) AS rows FROM lineitem, s GROUP BY ALL)""")
def agg15_range(spark, sf):
    return rounded(measures.histogram_over_range(table(spark, sf, "lineitem"), "l_extendedprice", 30), "bin_from", digits=4)


@query("agg16_quantiles", """SELECT l_shipmonth, p, round(value, 4) AS value FROM (
  SELECT month(l_shipdate) AS l_shipmonth, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS p, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS value FROM lineitem GROUP BY 1)""")
def agg16_quantiles(spark, sf):
    l = table(spark, sf, "lineitem").select(F.month("l_shipdate").alias("l_shipmonth"), "l_extendedprice")
    return rounded(measures.quantiles(l, ["l_shipmonth"], "l_extendedprice", [0.1, 0.5, 0.9]), "value", digits=4)


@query("agg19_hierarchical_totals", """SELECT c_mktsegment, o_orderpriority, round(sum(o_totalprice), 2) AS total,
CASE grouping_id(c_mktsegment, o_orderpriority) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)""")
def agg19(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return rounded(measures.hierarchical_totals(o.join(c, o.o_custkey == c.c_custkey), "c_mktsegment", "o_orderpriority", "o_totalprice"), "total")


@query("agg20_grouped_sum", "SELECT p_brand, p_type, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1, 2")
def agg20(spark, sf):
    return rounded(measures.sum_by(table(spark, sf, "part"), ["p_brand", "p_type"], "p_retailprice"), "total")


@query("agg21_axis_statistics", """WITH g AS (SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1), s AS (SELECT min(total) AS lo, max(total) AS hi FROM g)
SELECT lo, hi, lo > 0 AND hi / lo > 100 AS use_log, round(CASE WHEN lo > 0 THEN lo * 0.9 ELSE lo * 1.1 END, 4) AS range_min, round(hi * 1.1, 4) AS range_max FROM s""")
def agg21(spark, sf):
    return rounded(measures.axis_statistics(rounded(measures.sum_by(table(spark, sf, "part"), ["p_brand"], "p_retailprice"), "total"), "total"),
                   "range_min", "range_max", digits=4)


@query("win5_share_of_total", "SELECT p_brand, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 8) AS share FROM part GROUP BY 1")
def win5(spark, sf):
    s = measures.share_of_total(measures.sum_by(table(spark, sf, "part"), ["p_brand"], "p_retailprice"), "total")
    return rounded(s.select("p_brand", "share"), "share", digits=8)


@query("win6_share_of_parent", """WITH g AS (SELECT p_brand, p_type, sum(p_retailprice) AS total FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, round(total / sum(total) OVER (PARTITION BY p_brand), 8) AS share FROM g""")
def win6(spark, sf):
    s = measures.share_of_parent(measures.sum_by(table(spark, sf, "part"), ["p_brand", "p_type"], "p_retailprice"), "p_brand", "total")
    return rounded(s.select("p_brand", "p_type", "share"), "share", digits=8)


@query("win8_latest_searches", """SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank
FROM events WHERE event_type = 'view') WHERE rank <= 5""")
def win8(spark, sf):
    views = table(spark, sf, "events").filter(F.col("event_type") == "view")
    return ranking.top_per_key(views, ["user_id"], [F.desc("ts"), F.col("event_id")], 5, rank="rank").select("user_id", "event_id", "rank")


@query("win9_recent_runs", sql_with(FILE_PATHS) + """, r AS (SELECT scenario, run_id, max(o_orderdate) AS created FROM paths WHERE scenario IS NOT NULL GROUP BY 1, 2)
SELECT scenario, run_id, created FROM r QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY created DESC, run_id) <= 4""")
def win9(spark, sf):
    c = with_path_tags(file_paths(spark, sf), "path", 2).filter(F.col("scenario").isNotNull())
    runs = c.groupBy("scenario", "run_id").agg(F.max("o_orderdate").alias("created"))
    return ranking.top_per_key(runs, ["scenario"], [F.desc("created"), F.col("run_id")], 4)


@query("prj10_money_text", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS amount FROM lineitem""")
def prj10(spark, sf):
    money = F.concat(F.lit(" £"), F.format_number("l_extendedprice", 2), F.lit(" "))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", number_from_money(money).alias("amount"))


@query("prj15_code_labels", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Industry' END AS label FROM customer""")
def prj15(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", schema.label_codes(F.col("c_mktsegment"), {"BUILDING": "Construction", "MACHINERY": "Industry"}).alias("label"))


@query("prj16_described_codes", "SELECT s_suppkey, s_nationkey AS level_2, n_name AS level_2_description FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def prj16(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("description"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("level_2"))
    return schema.describe_codes(s, {"level_2": (n, True), "level_3": (n, False)})


@query("jon14_described_fields", """SELECT o_orderkey, 'c_' || c_name || ', c_' || c_name || '+' AS described FROM orders JOIN customer ON o_custkey = c_custkey""")
def jon14(spark, sf):
    """Each order lists two fields named by its customer and one unknown field."""
    name = F.col("o_custkey").cast("string")
    o = table(spark, sf, "orders").select("o_orderkey", F.array(name, F.lit("none"), F.concat(name, F.lit("+"))).alias("fields"))
    c = table(spark, sf, "customer")
    d = c.select(F.col("c_custkey").cast("string").alias("field"), F.concat(F.lit("c_"), "c_name").alias("description"))
    d = d.union(c.select(F.concat(F.col("c_custkey").cast("string"), F.lit("+")), F.concat(F.lit("c_"), "c_name", F.lit("+"))))
    found = schema.describe_fields(o, "o_orderkey", "fields", d)
    return found.select("o_orderkey", F.array_join(F.transform("described", lambda x: x["description"]), ", ").alias("described"))


@query("spc1_crosstab", """SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def spc1(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return transforms.crosstab(o.join(c, o.o_custkey == c.c_custkey), "c_mktsegment", "o_orderstatus", ["F", "O", "P"])


@query("spc2_unpivot", """SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS metric, l_discount AS score FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem""")
def spc2(spark, sf):
    return schema.to_long(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"])


@query("spc3_transpose", """WITH g AS (SELECT o_orderstatus AS s, count(*)::DOUBLE AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1)
SELECT 'orders' AS "column", max(orders) FILTER (s = 'F') AS "F", max(orders) FILTER (s = 'O') AS "O", max(orders) FILTER (s = 'P') AS "P" FROM g
UNION ALL SELECT 'revenue', max(revenue) FILTER (s = 'F'), max(revenue) FILTER (s = 'O'), max(revenue) FILTER (s = 'P') FROM g""")
def spc3(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return transforms.transpose(g, "o_orderstatus", ["F", "O", "P"], ["orders", "revenue"])


@query("spc4_hash_sample", "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000000 < 100000")
def spc4(spark, sf):
    return transforms.hash_sample(table(spark, sf, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query("spc5_append", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def spc5(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return transforms.append(c, s)


@query("spc6_fill_missing", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE o_orderpriority END AS label FROM orders")
def spc6_fill(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("label"))
    return transforms.fill_missing(o, {"label": "none"})


@query("spc6_fill_with_mean", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v FROM orders)
SELECT o_orderkey, round(coalesce(v, (SELECT avg(v) FROM o)), 4) AS v FROM o""")
def spc6_mean(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v"))
    return rounded(transforms.fill_with_mean(o, "v"), "v", digits=4)


@query("spc6_min_max", """SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w), 8) AS scaled
FROM orders WINDOW w AS (PARTITION BY o_orderstatus)""")
def spc6_minmax(spark, sf):
    return rounded(transforms.min_max(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"]).select("o_orderkey", "scaled"), "scaled", digits=8)


@query("spc6_z_score", """SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS z FROM orders""")
def spc6_z(spark, sf):
    return rounded(transforms.z_score(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "z"), "z", digits=6)


@query("spc7_summarise", """SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS min,
max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1""")
def spc7(spark, sf):
    return rounded(transforms.summarise(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice"), "mean", "sd", "q1", "median", "q3", digits=4)


@query("spc8_computed", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * 10000, 0) AS net, l_quantity > 25 AS bulk FROM lineitem")
def spc8(spark, sf):
    return transforms.compute(table(spark, sf, "lineitem"), {
        "net": "round(l_extendedprice * (1 - l_discount) * 10000, 0)", "bulk": "l_quantity > 25"}).select("l_orderkey", "l_linenumber", "l_partkey", "net", "bulk")


def daily(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("total"))


DAILY = "daily AS (SELECT event_type, ts::DATE AS day, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)"


@query("spc9_anomalies", sql_with(DAILY) + """, z AS (SELECT event_type, day, total, CASE WHEN count(total) OVER w = 7 THEN (total - avg(total) OVER w) / stddev_samp(total) OVER w END AS z
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT event_type, day::VARCHAR AS day, total, round(z, 6) AS z, coalesce(abs(z) > 2, false) AS is_anomaly FROM z""")
def spc9(spark, sf):
    a = transforms.anomalies(daily(spark, sf), "event_type", "day", "total")
    return rounded(a.withColumn("day", F.col("day").cast("string")), "z", digits=6)


@query("spc10_forecast", sql_with(DAILY) + """, s AS (SELECT event_type, datediff('day', DATE '2024-01-01', day) AS step, total FROM daily),
f AS (SELECT event_type, regr_slope(total, step) AS b, regr_intercept(total, step) AS a, max(step) AS last FROM s GROUP BY 1)
SELECT event_type, (last + n)::INT AS step, round(a + b * (last + n), 6) AS forecast FROM f, (SELECT unnest([1, 2, 3]) AS n)""")
def spc10(spark, sf):
    s = daily(spark, sf).withColumn("step", F.datediff("day", F.lit("2024-01-01").cast("date")))
    return rounded(transforms.linear_forecast(s, "event_type", "step", "total", 3), "forecast", digits=6)


def _seasonal_sql(ahead: int) -> str:
    """The same least squares in SQL: each term in turn is taken out of the values and of the later terms."""
    waves = [f"{f}({2 * h} * pi() * (x - first) / 7)" for h in (1, 2) for f in ("cos", "sin")]
    terms = ["1.0", "(x - first) / span", *waves]
    sql = f""", s AS (SELECT event_type, datediff('day', DATE '2024-01-01', day)::DOUBLE AS x, total AS y FROM daily),
ends AS (SELECT event_type, min(x) AS first, max(x) AS last, greatest(max(x) - min(x), 1) AS span FROM s GROUP BY 1),
both_times AS (SELECT * FROM s UNION ALL SELECT event_type, last + n, NULL FROM ends, (SELECT unnest(range(1, {ahead + 1})) AS n)),
z0 AS (SELECT event_type, x, y, y AS rest, 0.0 AS fit, 0.0 AS lever, {", ".join(f"{t} AS t{i}" for i, t in enumerate(terms))} FROM both_times JOIN ends USING (event_type))"""
    for k in range(len(terms)):
        later = range(k + 1, len(terms))
        over = lambda what: f"sum({what}) FILTER (WHERE y IS NOT NULL) OVER (PARTITION BY event_type)"
        sums = ", ".join([f"{over(f't{k} * t{k}')} AS own", f"{over(f't{k} * rest')} AS with_rest", *[f"{over(f't{k} * t{j}')} AS with_{j}" for j in later]])
        left = "".join(f", t{j} - t{k} * with_{j} / own AS t{j}" for j in later)
        sql += f""",
z{k + 1} AS (SELECT event_type, x, y, rest - t{k} * with_rest / own AS rest, fit + t{k} * with_rest / own AS fit, lever + t{k} * t{k} / own AS lever{left} FROM (SELECT *, {sums} FROM z{k}))"""
    return sql + f""",
reach AS (SELECT *, 1.96 * sqrt(sum(rest * rest) OVER (PARTITION BY event_type) / (count(y) OVER (PARTITION BY event_type) - {len(terms)})) * sqrt(1 + lever) AS reach FROM z{len(terms)})
SELECT event_type, x::BIGINT AS step, round(fit, 3) AS forecast, round(fit - reach, 3) AS low, round(fit + reach, 3) AS high, {len(terms)} AS terms FROM reach WHERE y IS NULL"""


@query("spc10_seasonal_forecast", sql_with(DAILY) + _seasonal_sql(7))
def spc10_seasonal(spark, sf):
    """A line and weekly waves with prediction intervals."""
    s = daily(spark, sf).withColumn("step", F.datediff("day", F.lit("2024-01-01").cast("date")))
    return rounded(seasonal.seasonal_forecast(s, "event_type", "step", "total", 7), "forecast", "low", "high", digits=3)


@query("agg_distinct_by_segment", "SELECT c_mktsegment AS segment, count(DISTINCT o_orderkey) AS distinct_ids, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg_distinct(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    d = measures.distinct_and_mean_by(o.join(c, o.o_custkey == c.c_custkey), F.col("c_mktsegment"), "segment", "o_orderkey", "o_totalprice")
    return rounded(d, "mean", digits=4)


@query("doc4_supported_formats_hits", """SELECT class, count(*) AS files FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'spreadsheet' WHEN 2 THEN 'audio' WHEN 3 THEN 'video' END AS class FROM orders)
WHERE class IS NOT NULL GROUP BY 1""")
def doc4(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".csv", ".mp3", ".mp4", ".zip")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    named = table(spark, sf, "orders").select(ext.alias("extension"))
    return named.join(documents.supported_formats(spark), "extension").groupBy("class").agg(F.count(F.lit(1)).alias("files"))

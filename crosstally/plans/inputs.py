"""Family inputs built from the relational tables, as DataFrames and as the matching SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..registry import table
from ..sources.readers import spread

BLANK = r"[\s\p{Z}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_key(x: str) -> str:
    inner = rf"regexp_replace({sql_strip(x)}, '\.0$', '')"
    return f"nullif(nullif(lower({sql_strip(inner)}), ''), 'nan')"


def sql_terms(x: str) -> str:
    return r"regexp_extract_all(lower(" + x + r"), '[\p{L}\p{N}_]{2,}')"


def sql_words(x: str) -> str:
    """Distinct words, split on white space, no empty ones."""
    return f"list_filter(list_distinct(regexp_split_to_array(lower({sql_strip(x)}), '{BLANK}+')), lambda w: w <> '')"


def sql_with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- company reconciliation --------------------------------------------------------------------

def counterparties(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.lit("2024-12-31").alias("cob_date"),
        F.col("c_mktsegment").alias("productype"),
        F.col("r_name").alias("legal_entity"),
        F.col("c_custkey").cast("string").alias("counterparty_id"),
        F.col("c_name").alias("counterparty_name"),
        F.col("n_nationkey").cast("string").alias("parent_id"),
        F.col("n_regionkey").cast("string").alias("group_id"),
        F.col("n_name").alias("group_name"),
        F.concat(F.lit("BIC"), F.col("n_nationkey").cast("string")).alias("bic_code"),
        F.concat(F.lit(" "), F.lower("n_name"), F.lit("\t")).alias("country_code"),
    )


COUNTERPARTIES = """counterparties AS (
  SELECT '2024-12-31' AS cob_date, c_mktsegment AS productype, r_name AS legal_entity,
         c_custkey::VARCHAR AS counterparty_id, c_name AS counterparty_name,
         n_nationkey::VARCHAR AS parent_id, n_regionkey::VARCHAR AS group_id, n_name AS group_name,
         'BIC' || n_nationkey AS bic_code, ' ' || lower(n_name) || chr(9) AS country_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored companies per year: padded upper-case name, revenue with thousands commas, percent as
    text ('n/a' for every seventh customer)."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    per_year = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("revenue"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("green"))
    percent = F.round(100 * F.col("green") / F.col("revenue"), 6)
    return per_year.join(c, per_year.o_custkey == c.c_custkey).select(
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t")).alias("companyName"),
        "year",
        F.format_number("revenue", 2).alias("totalRevenue"),
        F.when(F.col("o_custkey") % 7 == 0, "n/a").otherwise(percent.cast("string")).alias("greenRevenuePercent"),
        F.concat(F.lit("status mix of "), F.col("year").cast("string")).alias("justification"),
        F.lit("orders").alias("dataSources"),
        F.concat((F.col("o_custkey") % 90 + 10).cast("string"), F.lit("1110")).alias("naics_code"),
    )


SCORES = """per_year AS (
  SELECT o_custkey, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS revenue, sum(o_totalprice) AS raw_revenue,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) AS green
  FROM orders GROUP BY ALL),
scores AS (
  SELECT '  ' || upper(c_name) || chr(9) AS "companyName", year, revenue AS "totalRevenue",
         CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE round(100 * green / raw_revenue, 6) END AS "greenRevenuePercent",
         'status mix of ' || year AS justification, 'orders' AS "dataSources",
         (o_custkey % 90 + 10) || '1110' AS naics_code
  FROM per_year JOIN customer ON o_custkey = c_custkey)"""


def watch_list(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return c.select(
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("SDS"),
        F.concat(F.col("c_name"), F.lit(" ")).alias("Client Name"),
        F.when(F.col("c_custkey") % 2 == 0, "Energy").otherwise("Water").alias("Themes"),
        F.concat(F.lit("BIC"), F.col("c_nationkey").cast("string")).alias("BIC"),
    )


WATCH_LIST = """watch_list AS (
  SELECT c_custkey || '.0' AS "SDS", c_name || ' ' AS "Client Name",
         CASE WHEN c_custkey % 2 = 0 THEN 'Energy' ELSE 'Water' END AS "Themes", 'BIC' || c_nationkey AS "BIC"
  FROM customer WHERE c_mktsegment = 'BUILDING')"""

MATCHED_COLUMNS = (
    'cob_date, productype, legal_entity, counterparty_id, counterparty_name, parent_id, group_id, group_name, '
    'bic_code, country_code, year, "totalRevenue", "greenRevenuePercent", justification, "dataSources", pure_play_flag'
)


def sql_matched(join: str = "JOIN") -> str:
    return ",\n".join([COUNTERPARTIES, SCORES, f"""matched AS (
  SELECT c.*, s.year, s."totalRevenue", s."greenRevenuePercent", s.justification, s."dataSources",
         CASE WHEN s."greenRevenuePercent" >= 50 THEN 'Y' ELSE 'N' END AS pure_play_flag
  FROM counterparties c {join} scores s ON {sql_key('c.counterparty_name')} = {sql_key('s."companyName"')})"""])


# --- register -----------------------------------------------------------------------------------

def register_companies(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.upper("c_name").alias("CompanyName"),
        F.concat(F.lit("00"), F.col("c_custkey").cast("string")).alias("RawNumber"),
        F.regexp_replace(F.concat(F.lit("00"), F.col("c_custkey").cast("string")), "^0+", "").alias("CompanyNumber"),
        F.when(F.col("c_acctbal") >= 0, "Active").otherwise("Dormant").alias("CompanyStatus"),
        F.col("c_mktsegment").alias("SICText"),
        F.lower("c_name").alias("CompanyName_lower"),
    )


REGISTER = """register AS (
  SELECT upper(c_name) AS "CompanyName", regexp_replace('00' || c_custkey, '^0+', '') AS "CompanyNumber",
         CASE WHEN c_acctbal >= 0 THEN 'Active' ELSE 'Dormant' END AS "CompanyStatus",
         c_mktsegment AS "SICText", lower(c_name) AS "CompanyName_lower"
  FROM customer)"""

CUTOFF = "2000-01-01"


def judgements(spark: SparkSession, sf: str, current: bool) -> DataFrame:
    """Judgements from orders: those from the cut-off date on are current, older ones archived. Every
    11th has no date, every 13th carries a marker in its governance grade."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    o = o.filter(F.col("o_orderdate") >= cut if current else F.col("o_orderdate") < cut)
    digit = F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("R"), key.cast("string")).alias("Reg Code"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit("\t")).alias("Name of provider"),
        F.col("o_orderstatus").alias("Status"),
        F.concat(F.lit("C"), digit).alias("Con"),
        F.concat(F.lit("G"), digit, F.when(key % 13 == 0, "*").otherwise("")).alias("Gov"),
        F.concat(F.lit("V"), digit).alias("Via"),
        F.when(key % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Publication Date"),
    )


def sql_judgements(name: str, current: bool) -> str:
    op = ">=" if current else "<"
    return f"""{name} AS (
  SELECT * FROM (
    SELECT 'R' || o_orderkey AS "Reg Code", c_name AS "Provider", lower(c_name) AS "Provider_lower",
           o_orderstatus AS "Status", 'C' || o_orderpriority[1] AS "Con",
           'G' || o_orderpriority[1] || CASE WHEN o_orderkey % 13 = 0 THEN '*' ELSE '' END AS "Gov",
           'V' || o_orderpriority[1] AS "Via",
           CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "Publication Date"
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate {op} TIMESTAMP '{CUTOFF}')
  WHERE "Gov" NOT LIKE '%*%')"""


def client_sheets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Party to company number, and party to customer id, from suppliers."""
    s = table(spark, sf, "supplier")
    party = F.concat(F.lit("0"), F.col("s_suppkey").cast("string"))
    return (
        s.select(F.col("s_name").alias("name"), party.alias("CpartyId"),
                 F.concat(F.lit("000"), (F.col("s_suppkey") * 3 + 1).cast("string")).alias("MapId")),
        s.filter(F.col("s_suppkey") % 4 != 0).select(
            F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("CpartyId"),
            F.concat(F.lit("CU"), F.col("s_suppkey").cast("string")).alias("MapId")),
    )


CLIENTS = """clients AS (
  SELECT a.s_name AS name, regexp_replace('0' || a.s_suppkey, '^0+', '') AS "CpartyId",
         (a.s_suppkey * 3 + 1)::VARCHAR AS cohouse, 'CU' || a.s_suppkey AS cusid, true AS "ClientFlag"
  FROM supplier a WHERE a.s_suppkey % 4 <> 0)"""


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    """Loan facilities: one per supplier and return flag."""
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_suppkey", "l_returnflag").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("facility_limit"),
        F.round(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))), 2).alias("drawn_balance"),
        F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))), 2).alias("undrawn_balance"),
    ).select(F.col("l_suppkey").cast("string").alias("counterparty_id"),
             F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_returnflag")).alias("facility_id"),
             "drawn_balance", "facility_limit", "undrawn_balance")


FACILITIES = """facilities AS (
  SELECT l_suppkey::VARCHAR AS counterparty_id, l_suppkey || '-' || l_returnflag AS facility_id,
         round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 2) AS drawn_balance,
         round(sum(l_extendedprice), 2) AS facility_limit,
         round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 2) AS undrawn_balance
  FROM lineitem GROUP BY l_suppkey, l_returnflag)"""

LATEST = """latest AS (
  SELECT * EXCLUDE (source) FROM (
    SELECT *, 'current' AS source FROM current UNION ALL SELECT *, 'archived' AS source FROM archived)
  QUALIFY row_number() OVER (PARTITION BY "Provider_lower" ORDER BY "Publication Date"::TIMESTAMP DESC NULLS LAST,
                             source DESC, "Reg Code") = 1)"""

FINAL = """final AS (
  SELECT r.*, j."Reg Code", j."Provider", j."Status", j."Con", j."Gov", j."Via", j."Publication Date",
         j."Reg Code" IS NOT NULL AS "IsRegistered", c.name, c."CpartyId", c.cusid,
         coalesce(c."ClientFlag", false) AS "ClientFlag", f.facility_id, f.drawn_balance, f.facility_limit, f.undrawn_balance
  FROM register r LEFT JOIN latest j ON r."CompanyName_lower" = j."Provider_lower"
  LEFT JOIN clients c ON r."CompanyNumber" = c.cohouse
  LEFT JOIN facilities f ON c."CpartyId" = f.counterparty_id)"""

REGISTER_CTES = [REGISTER, sql_judgements("current", True), sql_judgements("archived", False), LATEST, CLIENTS, FACILITIES, FINAL]


# --- evaluation ---------------------------------------------------------------------------------

def records(spark: SparkSession, sf: str) -> DataFrame:
    """Question/answer records: a user turn followed by an assistant turn, the document of the same
    number as context and a benchmark text as ground truth. Missing texts are empty.

    The answer is found by an equi-join on (conversation, next turn): even a conversation with a
    large part of all turns spreads over the partitions.
    """
    c, d, b = (table(spark, sf, t) for t in ("conversations", "documents", "benchmark"))
    n = b.agg(F.count(F.lit(1)).alias("n")).scalar()
    ask = spread(c, "conv_id", "turn").filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    say = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = ask.join(say, ["conv_id", "turn"]).withColumn("item_id", F.col("conv_id") % n)
    return (
        pairs.join(d.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context")), "conv_id", "left")
        .join(b.select("item_id", F.col("text").alias("truth")), "item_id", "left")
        .select("conv_id", "turn", "question", "answer",
                F.coalesce("truth", F.lit("")).alias("truth"), F.coalesce("context", F.lit("")).alias("context"))
    )


RECORDS = """records AS (
  SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, coalesce(b.text, '') AS truth, coalesce(d.text, '') AS context
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  LEFT JOIN documents d ON d.doc_id = q.conv_id
  LEFT JOIN benchmark b ON b.item_id = q.conv_id % (SELECT count(*) FROM benchmark)
  WHERE q.role = 'user' AND a.role = 'assistant')"""


# --- catalogue ----------------------------------------------------------------------------------

def file_paths(spark: SparkSession, sf: str) -> DataFrame:
    """One catalogued file per order: folders for cycle, scenario, run, version and stage."""
    o = table(spark, sf, "orders")
    scenario = F.when(F.col("o_orderstatus") == "F", "baseline").when(F.col("o_orderstatus") == "O", "adverse").when(
        F.col("o_custkey") % 3 == 0, "severely_adverse").otherwise("other")
    return o.select(
        "o_orderkey", "o_orderdate", "o_totalprice",
        F.concat_ws("/", F.lit("lake"), F.lit("root"),
                    F.concat(F.lit("cycle"), F.year("o_orderdate").cast("string")), scenario,
                    F.concat(F.lit("run"), F.lpad(F.month("o_orderdate").cast("string"), 3, "0")),
                    F.concat(F.lit("v"), (F.col("o_custkey") % 3).cast("string")), F.lit("output"),
                    F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string"), F.lit(".CSV"))).alias("path"))


FILE_PATHS = """file_paths AS (
  SELECT o_orderkey, o_orderdate, o_totalprice, 'cycle' || year(o_orderdate) AS cycle,
         CASE WHEN o_orderstatus = 'F' THEN 'baseline' WHEN o_orderstatus = 'O' THEN 'adverse'
              WHEN o_custkey % 3 = 0 THEN 'severely_adverse' ELSE 'other' END AS scn,
         'run' || lpad(month(o_orderdate)::VARCHAR, 3, '0') AS run_id, 'v' || (o_custkey % 3) AS version,
         'orders_' || o_orderkey || '.CSV' AS file_name
  FROM orders),
paths AS (
  SELECT *, concat_ws('/', 'lake', 'root', cycle, scn, run_id, version, 'output', file_name) AS path,
         CASE WHEN scn <> 'other' THEN scn END AS scenario FROM file_paths)"""

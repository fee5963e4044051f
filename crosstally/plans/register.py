"""Registered queries: register assembly, eligibility, latest-per-key rules, paging."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions.dates import to_date_or_null
from ..functions.numbers import nulls_to_false
from ..operators import filters, measures, ranking, reconcile, register as reg, schema
from ..registry import query, table
from .inputs import (CLIENTS, FACILITIES, REGISTER, REGISTER_CTES, client_sheets, facilities, judgements, register_companies,
                     sql_judgements, sql_with)

CURRENT, ARCHIVED = sql_judgements("current", True), sql_judgements("archived", False)
JUDGEMENT = ["Reg Code", "Provider", "Status", "Con", "Gov", "Via", "Publication Date"]
NAMED = ", ".join(f'"{c}"' for c in JUDGEMENT)
FINAL = sql_with(*REGISTER_CTES)
ELIGIBLE = """("IsRegistered" AND "CompanyStatus" = 'Active' AND (coalesce("Con" IN ('C1','C2','C3','C4'), false)
  OR coalesce("Gov" IN ('G1','G2','G3','G4'), false) OR coalesce("Via" IN ('V1','V2','V3','V4'), false)))"""


def clean(spark, sf, current):
    return reg.clean_judgements(judgements(spark, sf, current))


def combined(spark, sf):
    return reg.combine(clean(spark, sf, True), clean(spark, sf, False))


def prepared(spark, sf):
    return reg.prepare_judgements(reg.latest_judgements(combined(spark, sf)))


def clients(spark, sf):
    return reg.client_map(*client_sheets(spark, sf))


def final(spark, sf):
    return reg.assemble(register_companies(spark, sf), prepared(spark, sf), clients(spark, sf), facilities(spark, sf))


def eligible():
    return filters.eligible_broad(F.col("IsRegistered"), *[F.col(c) for c in ("CompanyStatus", "Con", "Gov", "Via")])


@query("prj5_clean_judgements", sql_with(CURRENT) + f"SELECT {NAMED} FROM current")
def prj5(spark, sf):
    return clean(spark, sf, True).select(*JUDGEMENT)


@query("set1_combine_judgements", sql_with(CURRENT, ARCHIVED) + """SELECT "Reg Code", source, "Publication Date"::TIMESTAMP AS sort_date FROM (
SELECT *, 'current' AS source FROM current UNION ALL SELECT *, 'archived' FROM archived)""")
def set1(spark, sf):
    return combined(spark, sf).select("Reg Code", "source", "sort_date")


@query("win1_latest_judgement", FINAL + f"SELECT {NAMED} FROM latest")
def win1(spark, sf):
    return reg.latest_judgements(combined(spark, sf)).select(*JUDGEMENT)


@query("win2_archived_nulls_first", sql_with(CURRENT, ARCHIVED) + f"""SELECT {NAMED} FROM archived
WHERE "Provider_lower" NOT IN (SELECT "Provider_lower" FROM current)
QUALIFY row_number() OVER (PARTITION BY "Provider_lower" ORDER BY "Publication Date" DESC NULLS FIRST, "Reg Code") = 1""")
def win2(spark, sf):
    return reg.archived_only(clean(spark, sf, False), clean(spark, sf, True)).select(*JUDGEMENT)


@query("jon12_archived_not_current", sql_with(CURRENT, ARCHIVED) + """SELECT "Reg Code", "Provider" FROM archived
WHERE "Provider_lower" NOT IN (SELECT "Provider_lower" FROM current)""")
def jon12(spark, sf):
    a, c = clean(spark, sf, False), clean(spark, sf, True)
    return reconcile.only_left(a, c, "Provider_lower", keep_missing=False).select("Reg Code", "Provider")


@query("set2_union_same_schema", sql_with(CURRENT, ARCHIVED) + f"""SELECT {NAMED}, NULL AS "Route" FROM current
UNION ALL SELECT {NAMED}, NULL FROM archived""")
def set2(spark, sf):
    wanted = T.StructType([T.StructField(c, T.StringType()) for c in [*JUDGEMENT, "Route"]])
    return schema.conform(clean(spark, sf, True), wanted).unionByName(schema.conform(clean(spark, sf, False), wanted))


@query("prj2_conform", FINAL + """SELECT "Reg Code", "Provider", NULL AS "Landlord Type", "Status", NULL AS "Rent Y", "Provider_lower" FROM latest""")
def prj2(spark, sf):
    return prepared(spark, sf).select("Reg Code", "Provider", "Landlord Type", "Status", "Rent Y", "Provider_lower")


@query("prj11_sentinel_to_null", sql_with(CURRENT) + """SELECT "Reg Code", nullif("Gov", 'G3') AS "Gov" FROM current""")
def prj11(spark, sf):
    return schema.text_to_null(clean(spark, sf, True), ["Gov"], ("G3",)).select("Reg Code", "Gov")


@query("jon3_with_judgements", FINAL + """SELECT "CompanyName", "CompanyNumber", j."Reg Code", j."Status" FROM register
LEFT JOIN latest j ON "CompanyName_lower" = "Provider_lower" """)
def jon3(spark, sf):
    return reg.with_judgements(register_companies(spark, sf), prepared(spark, sf)).select(
        "CompanyName", "CompanyNumber", "Reg Code", "Status")


@query("jon4_with_clients", sql_with(REGISTER, CLIENTS) + """SELECT "CompanyNumber", name, "CpartyId", cusid, coalesce("ClientFlag", false) AS "ClientFlag"
FROM register LEFT JOIN clients ON "CompanyNumber" = cohouse""")
def jon4(spark, sf):
    return reg.with_clients(register_companies(spark, sf), clients(spark, sf)).select(
        "CompanyNumber", "name", "CpartyId", "cusid", "ClientFlag")


@query("jon5_with_facilities", sql_with(REGISTER, CLIENTS, FACILITIES) + """SELECT "CompanyNumber", "CpartyId", facility_id, drawn_balance
FROM register LEFT JOIN clients ON "CompanyNumber" = cohouse LEFT JOIN facilities ON "CpartyId" = counterparty_id""")
def jon5(spark, sf):
    c = reg.with_clients(register_companies(spark, sf), clients(spark, sf))
    return reg.with_facilities(c, facilities(spark, sf)).select("CompanyNumber", "CpartyId", "facility_id", "drawn_balance")


@query("jon6_client_map", sql_with(CLIENTS) + "SELECT * FROM clients")
def jon6(spark, sf):
    return clients(spark, sf)


@query("jon7_register_assembly", FINAL + """SELECT "CompanyName", "CompanyNumber", "CompanyStatus", "Reg Code", "Status", "Gov", "IsRegistered",
name, "ClientFlag", facility_id, drawn_balance, facility_limit FROM final""")
def jon7(spark, sf):
    return final(spark, sf).select("CompanyName", "CompanyNumber", "CompanyStatus", "Reg Code", "Status", "Gov", "IsRegistered",
                                   "name", "ClientFlag", "facility_id", "drawn_balance", "facility_limit")


@query("prj13_prj14_flags", FINAL + """SELECT "CompanyNumber", "ClientFlag", "IsRegistered" FROM final""")
def prj13(spark, sf):
    return final(spark, sf).select("CompanyNumber", nulls_to_false(F.col("ClientFlag")).alias("ClientFlag"),
                                   F.col("Reg Code").isNotNull().alias("IsRegistered"))


@query("flt3_contains", FINAL + """SELECT "CompanyNumber", facility_id FROM final
WHERE contains(lower("CompanyName"), '#00000001') OR contains(lower(coalesce("Provider", '')), '#00000001')""")
def flt3(spark, sf):
    return final(spark, sf).filter(filters.contains_any([F.col("CompanyName"), F.col("Provider")], "#00000001")).select(
        "CompanyNumber", "facility_id")


@query("flt4_regex", FINAL + """SELECT "CompanyNumber", facility_id FROM final
WHERE regexp_matches(lower("CompanyName"), '[15]$') OR coalesce(regexp_matches(lower("Provider"), '[15]$'), false)""")
def flt4(spark, sf):
    return final(spark, sf).filter(filters.matches_any([F.col("CompanyName"), F.col("Provider")], "[15]$")).select(
        "CompanyNumber", "facility_id")


@query("flt5_facets", FINAL + """SELECT "CompanyNumber", facility_id FROM final WHERE contains(lower("CompanyName"), '1')
AND "CompanyStatus" IN ('Active') AND "Reg Code" IS NOT NULL AND "Gov" IN ('G1', 'G2')""")
def flt5(spark, sf):
    return filters.facets(final(spark, sf), search="1", search_in=("CompanyName",), present={"Reg Code": True},
                          CompanyStatus=["Active"], Gov=["G1", "G2"], Via=[]).select("CompanyNumber", "facility_id")


@query("flt6_eligible_strict", FINAL + """SELECT "CompanyNumber", facility_id FROM final WHERE "IsRegistered" AND "CompanyStatus" = 'Active'
AND "Gov" IN ('G1', 'G2') AND "Via" IN ('V1', 'V2')""")
def flt6(spark, sf):
    test = filters.eligible_strict(F.col("IsRegistered"), F.col("CompanyStatus"), F.col("Gov"), F.col("Via"))
    return final(spark, sf).filter(test).select("CompanyNumber", "facility_id")


@query("flt7_eligible_broad", FINAL + f"""SELECT "CompanyNumber", facility_id FROM final WHERE {ELIGIBLE}""")
def flt7(spark, sf):
    return final(spark, sf).filter(eligible()).select("CompanyNumber", "facility_id")


@query("flt8_without_marker", f"""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 13 <> 0""")
def flt8(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 13 == 0, "G1*").when(F.col("o_orderkey") % 5 != 0, "G1").alias("Gov"))
    return filters.without_marker(raw, ["Gov", "Via"]).select("id")


@query("agg1_key_figures", FINAL + f"""SELECT count(*) AS rows, count(*) FILTER ("IsRegistered") AS registered, count(*) FILTER (NOT "IsRegistered") AS unregistered,
count("Status") AS judged, count(*) - count("Status") AS unjudged, count(*) FILTER ({ELIGIBLE}) AS eligible,
count(*) FILTER ("ClientFlag") AS clients FROM final""")
def agg1(spark, sf):
    return measures.key_figures(final(spark, sf), {
        "registered": F.col("IsRegistered"), "unregistered": ~F.col("IsRegistered"), "judged": F.col("Status").isNotNull(),
        "unjudged": F.col("Status").isNull(), "eligible": eligible(), "clients": F.col("ClientFlag")})


@query("agg2_count_by_grade", FINAL + """SELECT "Gov", count(*) AS rows FROM final WHERE "Gov" IS NOT NULL GROUP BY 1""")
def agg2(spark, sf):
    return measures.count_by(final(spark, sf), "Gov")


@query("agg2_missing_grade", FINAL + """SELECT count(*) FILTER ("CpartyId" IS NULL) AS missing FROM final""")
def agg2_missing(spark, sf):
    return measures.missing_count(final(spark, sf), "CpartyId")


@query("agg11_balances", FINAL + """SELECT round(coalesce(sum(drawn_balance), 0), 2) AS drawn_balance, round(coalesce(sum(undrawn_balance), 0), 2) AS undrawn_balance,
round(coalesce(sum(facility_limit), 0), 2) AS facility_limit,
round(coalesce(sum(CASE WHEN drawn_balance IS NOT NULL AND undrawn_balance IS NOT NULL THEN drawn_balance END), 0), 2) AS drawn_balance_complete,
round(coalesce(sum(CASE WHEN drawn_balance IS NOT NULL AND undrawn_balance IS NOT NULL THEN undrawn_balance END), 0), 2) AS undrawn_balance_complete
FROM final""")
def agg11(spark, sf):
    t = measures.totals(final(spark, sf), ["drawn_balance", "undrawn_balance", "facility_limit"], ["drawn_balance", "undrawn_balance"])
    return t.select(*[F.round(c, 2).alias(c) for c in t.columns])


@query("set6_scope_overlaps", FINAL + f""", el AS (SELECT * FROM final WHERE {ELIGIBLE}), cl AS (SELECT * FROM final WHERE "ClientFlag"),
sc AS (SELECT * FROM register WHERE "SICText" IN ('BUILDING', 'MACHINERY')),
m AS (SELECT "CompanyNumber" IN (SELECT "CompanyNumber" FROM sc) AS s, "CompanyNumber" IN (SELECT "CompanyNumber" FROM el) AS e,
        "CompanyNumber" IN (SELECT "CompanyNumber" FROM cl) AS c FROM register)
SELECT 'rows_scope' AS measure, (SELECT count(*) FROM sc) AS value UNION ALL SELECT 'rows_eligible', (SELECT count(*) FROM el)
UNION ALL SELECT 'rows_client', (SELECT count(*) FROM cl)
UNION ALL SELECT n, (SELECT count(*) FROM m WHERE s = x AND e = y AND c = z) FROM (VALUES ('keys_scope', true, false, false),
 ('keys_eligible', false, true, false), ('keys_scope_eligible', true, true, false), ('keys_client', false, false, true),
 ('keys_scope_client', true, false, true), ('keys_eligible_client', false, true, true),
 ('keys_scope_eligible_client', true, true, true)) t(n, x, y, z)""")
def set6(spark, sf):
    scope = register_companies(spark, sf).filter(F.col("SICText").isin("BUILDING", "MACHINERY"))
    return reconcile.scope_overlaps(scope, final(spark, sf), eligible(), F.col("ClientFlag"), "CompanyNumber")


@query("prj17_blank_rows", "SELECT count(*) FILTER (o_orderkey % 6 <> 0) AS kept, count(*) FILTER (o_orderkey % 6 = 0) AS removed FROM orders")
def prj17(spark, sf):
    raw = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 6 == 0, F.when(F.col("o_orderkey") % 12 == 0, "")).otherwise("x").alias("Provider"))
    return schema.blank_row_counts(raw, "Provider")


@query("prj17_drop_blank", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 6 <> 0")
def prj17_drop(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 6 == 0, F.when(F.col("o_orderkey") % 12 == 0, "")).otherwise("x").alias("Provider"))
    return schema.drop_blank(raw, "Provider").select("id")


@query("prj3_prj4_prj7_header", "SELECT s_suppkey AS id, s_name AS supplier, 'current' AS source, '' AS route FROM supplier")
def prj3(spark, sf):
    raw = table(spark, sf, "supplier").select(F.col("s_suppkey").alias(" 'id' "), F.col("s_name"))
    return schema.tag(schema.rename(schema.clean_header(raw), {"s_name": "supplier"}), source="current", route="")


@query("prj6_required_columns", "SELECT c_custkey, c_name FROM customer")
def prj6(spark, sf):
    return schema.require_columns(table(spark, sf, "customer"), ["c_custkey", "c_name"]).select("c_custkey", "c_name")


@query("scl12_parse_dates", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS parsed FROM orders""")
def scl12(spark, sf):
    raw = F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("not published")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), to_date_or_null(raw).alias("parsed"))


@query("win3_first_per_subset", """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1""")
def win3(spark, sf):
    return ranking.first_per_subset(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")]).select(
        "o_orderkey", "o_custkey", "o_orderstatus")


@query("snk6_page", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000 OFFSET 1000""")
def snk6(spark, sf):
    return ranking.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                        [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


@query("snk6_page_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1000")
def snk6_after(spark, sf):
    return ranking.page_after(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query("scl21_page_count", "SELECT count(*) AS rows, ceil(count(*) / 1000.0)::BIGINT AS pages FROM lineitem")
def scl21(spark, sf):
    return ranking.page_total(table(spark, sf, "lineitem"))


@query("srt1_sort", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer")
def srt1(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment", "c_acctbal", "c_custkey").orderBy(
        F.asc("c_mktsegment"), F.desc_nulls_last("c_acctbal"), F.asc("c_custkey"))


@query("srt2_ordinal_sort", """SELECT strftime(o_orderdate, '%b') AS month, count(*) AS orders FROM orders GROUP BY 1""")
def srt2(spark, sf):
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun"]
    per = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "MMM").alias("month")).agg(F.count(F.lit(1)).alias("orders"))
    return ranking.order_by_labels(per, "month", months)


@query("srt3_top_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def srt3(spark, sf):
    return ranking.top_rows(table(spark, sf, "customer").select("c_custkey", "c_acctbal"),
                            [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], 10)


@query("srt5_preview", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5")
def srt5(spark, sf):
    return ranking.top_rows(table(spark, sf, "part").select("p_partkey", "p_name"), [F.col("p_partkey")], 5)


@query("agg24_picker_values", "SELECT DISTINCT p_brand FROM part")
def agg24(spark, sf):
    return measures.pick_values(table(spark, sf, "part"), "p_brand")


@query("flt1_flt2_membership", """SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_name IS NOT NULL""")
def flt1(spark, sf):
    return filters.facets(table(spark, sf, "customer"), present={"c_name": True}, c_mktsegment=["BUILDING", "FURNITURE"]).select("c_custkey")


@query("flt13_known_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def flt13(spark, sf):
    known = table(spark, sf, "orders").filter(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return filters.rows_with_known_key(table(spark, sf, "customer"), known, "c_custkey").select("c_custkey", "c_name")


@query("flt14_first_row", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def flt14(spark, sf):
    return filters.first_row(table(spark, sf, "orders"), "o_orderstatus", "F", [F.col("o_orderdate"), F.col("o_orderkey")]).select(
        "o_custkey", "o_orderkey")

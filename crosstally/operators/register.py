"""Register assembly: current and archived judgements, latest per provider, client map, facilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.keys import as_text, lower_key, unpadded_key
from .filters import without_marker
from .joins import fan_out_join
from .ranking import latest_per_key
from .schema import conform, drop_blank, q, rename_containing, text_to_null

# The judgement columns in their order.
JUDGEMENT_COLUMNS = [
    "Reg Code", "Provider", "Landlord Type", "Name and Reg Code Change Details",
    "Other providers included in the judgement", "Status", "Con", "Con Date", "Con Change",
    "Gov", "Gov Date", "Gov Change", "Via", "Via Date", "Via Change", "Rent Y", "Rent Date",
    "Rent Change", "Type of Publication", "Publication Date", "Engagement Process", "Route", "Explanation",
]
JUDGEMENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in JUDGEMENT_COLUMNS])


def clean_judgements(df: DataFrame) -> DataFrame:
    """Find the provider column, clean its key, drop blank providers and ratings marked with ``*``."""
    df = rename_containing(df, "provider", "Provider")
    df = df.withColumn("Provider", unpadded_key(as_text(df, "Provider"), lower=False))
    df = drop_blank(df, "Provider").withColumn("Provider_lower", lower_key(F.col("Provider")))
    return without_marker(df, ["Gov", "Via"])


def combine(current: DataFrame, archived: DataFrame, date: str = "Publication Date") -> DataFrame:
    """Union on the shared columns, tagged with the source, date parsed (unreadable dates become null)."""
    shared = [c for c in current.columns if c in archived.columns]
    parts = [df.select(*[q(c) for c in shared]).withColumn("source", F.lit(s))
             for df, s in ((current, "current"), (archived, "archived"))]
    return parts[0].unionByName(parts[1]).withColumn("sort_date", q(date).try_cast("timestamp_ntz"))


def latest_judgements(combined: DataFrame, tiebreak: str = "Reg Code") -> DataFrame:
    """Newest judgement per provider, undated ones last; of equal dates the current source wins."""
    picked = latest_per_key(combined, "Provider_lower", "sort_date", [F.col("source").desc(), q(tiebreak)])
    return picked.drop("source", "sort_date")


def archived_only(archived: DataFrame, current: DataFrame, date: str = "Publication Date",
                  tiebreak: str = "Reg Code") -> DataFrame:
    """Newest archived judgement of providers absent from the current list; an undated one counts as newest.

    Rows without provider are dropped. The newest row is picked before the anti join, so a provider
    with very many judgements is reduced to one row in the map tasks.
    """
    known = archived.filter(F.col("Provider_lower").isNotNull())
    newest = latest_per_key(known, "Provider_lower", date, [q(tiebreak)], nulls="first")
    return newest.join(current.select("Provider_lower").distinct(), "Provider_lower", "left_anti")


def prepare_judgements(df: DataFrame, schema: T.StructType = JUDGEMENT_SCHEMA) -> DataFrame:
    """Target columns in order, sentinels to null, plus the lower-cased provider."""
    out = conform(df, schema)
    return text_to_null(out, ["Reg Code", "Gov", "Via"], ("nan",)).withColumn(
        "Provider_lower", lower_key(F.col("Provider")))


def with_judgements(register: DataFrame, judgements: DataFrame) -> DataFrame:
    """Left join on the lower-cased name; registered means a registration code was found."""
    joined = register.join(judgements, register["CompanyName_lower"] == judgements["Provider_lower"], "left")
    return joined.withColumn("IsRegistered", F.col("Reg Code").isNotNull())


def client_map(companies: DataFrame, customers: DataFrame) -> DataFrame:
    """Company numbers and customer ids of the same party, with the client flag.

    Inputs: ``name, CpartyId, MapId`` (company number) and ``CpartyId, MapId`` (customer id).
    """
    c = companies.select("name", unpadded_key(as_text(companies, "CpartyId")).alias("CpartyId"),
                         unpadded_key(as_text(companies, "MapId"), lower=False).alias("cohouse"))
    u = customers.select(unpadded_key(as_text(customers, "CpartyId")).alias("CpartyId"),
                         F.col("MapId").alias("cusid"))
    return c.join(u, "CpartyId").select("name", "CpartyId", "cohouse", "cusid", F.lit(True).alias("ClientFlag"))


def with_clients(register: DataFrame, clients: DataFrame) -> DataFrame:
    """Left join on the unpadded company number; no partner means no client."""
    joined = register.join(clients, register["CompanyNumber"] == clients["cohouse"], "left").drop("cohouse")
    return joined.withColumn("ClientFlag", F.coalesce("ClientFlag", F.lit(False)))


def with_facilities(register: DataFrame, facilities: DataFrame) -> DataFrame:
    """Left join to facilities on the party id; a company with several facilities gives several rows."""
    return fan_out_join(register, facilities, "CpartyId", "counterparty_id")


def assemble(register: DataFrame, judgements: DataFrame, clients: DataFrame, facilities: DataFrame) -> DataFrame:
    """Register with judgements, clients and facilities in one plan."""
    return with_facilities(with_clients(with_judgements(register, judgements), clients), facilities)

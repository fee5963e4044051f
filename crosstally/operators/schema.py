"""Projection, schema and cleansing operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.keys import strip


def q(name: str) -> Column:
    """Column by exact name, dots and blanks included."""
    return F.col(f"`{name}`")


def select_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[q(c) for c in columns if c in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; those absent become null."""
    return df.select(*[
        (q(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def clean_header(df: DataFrame) -> DataFrame:
    """Strip blanks and single quotes around every column name."""
    return df.toDF(*[c.strip().strip("'").strip() for c in df.columns])


def rename_containing(df: DataFrame, word: str, to: str) -> DataFrame:
    """Rename the first column whose name contains ``word`` (ignoring case)."""
    hit = next((c for c in df.columns if word.lower() in c.lower()), None)
    if hit is None:
        raise ValueError(f"no column contains {word!r}: {df.columns}")
    return df.withColumnRenamed(hit, to)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def tag(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def text_to_null(df: DataFrame, columns: list[str], sentinels: tuple[str, ...] = ("nan", "")) -> DataFrame:
    return df.withColumns({c: F.when(~q(c).isin(*sentinels), q(c)) for c in columns if c in df.columns})


def label_codes(c: Column, labels: dict[str, str]) -> Column:
    """Label of a code from a literal table; unknown codes become null."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.try_element_at(table, c)


def expand_code_ranges(labels: dict[str, str]) -> dict[str, str]:
    """``{'31-33': x}`` becomes one entry for each of 31, 32 and 33."""
    out = {}
    for code, label in labels.items():
        first, _, last = code.partition("-")
        out |= {str(n): label for n in range(int(first), int(last or first) + 1)}
    return out


def describe_codes(df: DataFrame, mappings: dict[str, tuple[DataFrame, bool]]) -> DataFrame:
    """Add ``<column>_description`` from a (code, description) table per column; a mapping switched
    off is skipped. Spark broadcasts a mapping only if its size is under the session's limit."""
    for column, (mapping, enabled) in mappings.items():
        if enabled:
            lookup = mapping.select(F.col("code").alias(column), F.col("description").alias(f"{column}_description"))
            df = df.join(lookup, column, "left")
    return df


# Fields with more than this share of all entries are looked up apart from the others.
FREQUENT_FIELDS = 1 / 64


def describe_fields(df: DataFrame, key: str, fields: str, dictionary: DataFrame) -> DataFrame:
    """Per row (unique ``key``) the known entries of a list of field names as (field, description)
    structs in list order. ``dictionary``: field, description, one row per field.

    The most frequent fields, known or not, do not travel: their few descriptions go to all tasks. Any choice of them
    gives the same rows; the one taken has all above ``FREQUENT_FIELDS``.
    """
    each = df.select(q(key), F.posexplode(q(fields)).alias("position", "field")).filter("field is not null")
    known = dictionary.select("field", "description")
    often = each.select("field").stat.freqItems(["field"], FREQUENT_FIELDS).first()[0]
    there = F.col("field").isin(often)
    columns = [q(key), "position", "field", "description"]
    found = each.filter(there).join(F.broadcast(known.filter(there)), "field").select(*columns).union(
        each.filter(~there).join(known, "field").select(*columns))
    listed = F.array_sort(F.collect_list(F.struct("position", "field", "description")))
    return found.groupBy(q(key)).agg(
        F.transform(listed, lambda x: F.struct(x["field"].alias("field"), x["description"].alias("description"))).alias("described"))


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(q(column).isNotNull() & (q(column) != ""))


def blank_row_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows kept and removed by :func:`drop_blank`, in one pass."""
    kept = F.count_if(q(column) != "")
    return df.agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("removed"))


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "score") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def trim_all(df: DataFrame) -> DataFrame:
    """Strip every text column."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: strip(q(c)) for c in text})

"""Key normalisation shared by every join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# ASCII blanks plus Unicode separators: what a text strip is expected to remove.
BLANKS = r"[\s\p{Z}]"


BLANK_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` alone only removes spaces)."""
    return F.btrim(c, F.lit(BLANK_CHARACTERS))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def as_text(df: DataFrame, name: str) -> Column:
    """Column as text; integral floating ids print without exponent or fraction."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(~F.isnan(c), F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string")))
    return c.cast("string")


def basic_key(c: Column, missing: str | None = None) -> Column:
    """Strip and lower-case. Missing stays null (never matches) unless ``missing`` names a filler
    text, which makes missing keys match each other."""
    key = F.lower(strip(c))
    return key if missing is None else F.coalesce(key, F.lit(missing))


def robust_key(c: Column) -> Column:
    """Strip, drop a trailing ``.0`` left by numeric ids, lower-case; blank and 'nan' become null."""
    text = strip(c)
    key = F.lower(strip(F.when(text.endswith(".0"), F.left(text, F.length(text) - 2)).otherwise(text)))
    return F.when(~key.isin("", "nan"), key)


def unpadded_key(c: Column, lower: bool = True) -> Column:
    """Strip and remove leading zeros, so ``'000123'`` equals ``'123'``."""
    key = F.ltrim(strip(c), F.lit("0"))
    return F.lower(key) if lower else key


def lower_key(c: Column) -> Column:
    return F.lower(c)


def code_key(c: Column) -> Column:
    """Upper-cased, stripped code such as a country code."""
    return F.upper(strip(c))


def with_keys(df: DataFrame, keys: dict[str, str], make=robust_key) -> DataFrame:
    """Add one normalised key column per entry ``{new column: source column}``; absent sources are skipped."""
    return df.withColumns({k: make(as_text(df, c)) for k, c in keys.items() if c in df.columns})

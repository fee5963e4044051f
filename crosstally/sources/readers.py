"""Readers: delimited text, JSON, Parquet, file listings, partitioned folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.paths import separator_for
from ..operators.schema import clean_header, require_columns, trim_all


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to as many partitions as the session asks for in ``spark.crosstally.spread``; as they come if it
    asks for none. For costly work per row on tables of one row group, which Spark reads in one task."""
    n = df.sparkSession.conf.get("spark.crosstally.spread", None)
    return df.repartition(int(n), *keys) if n else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str | None = None,
             encoding: str = "UTF-8", tolerant: bool = False, where: Column | None = None) -> DataFrame:
    """Headered delimited text. Without schema the columns are inferred (one more pass over the file).

    ``tolerant`` turns cells that do not fit the schema into null; ``where`` is applied at the scan.
    """
    reader = (
        spark.read.option("header", True).option("sep", sep or separator_for(path)).option("encoding", encoding)
        .option("mode", "PERMISSIVE" if tolerant else "FAILFAST").option("quote", '"').option("escape", '"')
    )
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df if where is None else df.filter(where)


def read_corrupt_aware(spark: SparkSession, path: str, schema: T.StructType, sep: str | None = None) -> DataFrame:
    """Tolerant read that also keeps the text of lines with bad cells in ``_corrupt_record``."""
    wide = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.option("header", True).option("sep", sep or separator_for(path)).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").schema(wide).csv(path))


def read_multiline_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Delimited text with line breaks inside quoted cells and an optional byte order mark."""
    return clean_header(spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                        .schema(schema).csv(path))


def read_trimmed(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "ISO-8859-1") -> DataFrame:
    return trim_all(read_csv(spark, path, schema, encoding=encoding))


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first non-blank character is ``[``; only that character reaches the driver."""
    first = spark.read.text(path).select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).filter("c <> ''").limit(1).collect()
    return bool(first) and first[0]["c"] == "["


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, or one JSON array per file, told apart by a look at the file."""
    reader = spark.read.option("multiLine", is_json_array(spark, path))
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_after_preamble(spark: SparkSession, path: str, skip: int, sep: str | None = None) -> DataFrame:
    """Delimited text whose header follows ``skip`` lines of preamble in every file; all columns text.

    Only a file's first split can hold its preamble, so lines are numbered within first splits alone.
    """
    sep = sep or separator_for(path)
    head = spark.read.text(path).limit(skip + 1).collect()
    if len(head) <= skip:
        raise ValueError(f"{path} has no header after {skip} lines")
    names = [c.strip().strip('"') for c in head[-1]["value"].split(sep)]
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"))
    numbered = raw.filter("start = 0").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    lines = numbered.filter(F.col("n") > skip + 1).select("value").union(raw.filter("start > 0").select("value"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    row = F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " ") if all(n.isidentifier() for n in names)
                     else ", ".join(f"`{n}` string" for n in names), {"sep": sep, "escape": '"'})
    return lines.filter("value <> ''").select(row.alias("r")).select("r.*")


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Files below a folder with size and time; contents are not read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
          .select("path", "length", "modificationTime"))
    if extensions:
        lowered = F.lower("path")
        df = df.filter(reduce(lambda a, b: a | b, [lowered.endswith(e.lower()) for e in extensions]))
    return df


def newest_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files matching a glob, newest first (ties by path)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    return df.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), F.desc("path"))


def read_partitioned(spark: SparkSession, base: str, schema: T.StructType | str, sep: str = "|") -> DataFrame:
    """Delimited files in ``cycle=…/scenario=…/run_id=…`` folders; filters on those columns prune folders."""
    return spark.read.option("basePath", base).option("sep", sep).option("header", True).schema(schema).csv(base)


def load_all(spark: SparkSession, inputs: dict[str, tuple[str, str, list[str]]]) -> dict[str, DataFrame]:
    """Several inputs ``{name: (format, path, required columns)}``; fails if one is absent or incomplete."""
    return {
        name: require_columns(spark.read.format(fmt).option("header", True).load(path), required)
        for name, (fmt, path, required) in inputs.items()
    }

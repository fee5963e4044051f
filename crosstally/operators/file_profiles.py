"""Profiles of many delimited files of unlike columns in one pass, without a step for each file.

All files of one separator are read together, as text cells by position. A task reduces its part of each file to a
partial profile of every column: whether all values are whole or decimal numbers, and the smallest distinct values
read in either way. Partial profiles merge (flags by "and", samples by the smallest again), so a file may be cut
into any number of parts, and nothing that grows with the rows is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import materialise
from .catalogue import NUMBER_SAMPLES, TEXT_SAMPLES

# How whole and decimal numbers are written. Longer digits than a long surely holds are decimals.
WHOLE = r"^[+-]?[0-9]{1,18}$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

PROFILE = "path string, column string, data_type string, sample_values array<string>"


def file_key(path: Column, encoded: bool = False) -> Column:
    """A path with one slash after its scheme, as listings and scans write it differently; a scan's is URL-encoded."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(plain, "^([a-z0-9]+):/+", "$1:/")


def _literal(path: str) -> str:
    """A path that readers do not take for a pattern."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: (file, position) with flags and the smallest values as whole numbers, decimals and texts."""
    kept: dict[tuple[str, int], list] = {}

    def smallest(old: pa.Array | None, new: pa.Array, k: int) -> pa.Array:
        values = pc.unique(new if old is None else pa.concat_arrays([old, new]))
        return values.take(pc.array_sort_indices(values)[:k])

    for batch in batches:
        files = pc.unique(batch.column(0))
        for file in files.to_pylist():
            part = batch if len(files) == 1 else batch.filter(pc.equal(batch.column(0), file))
            for position in range(part.num_columns - 1):
                if part.column(position + 1).null_count == part.num_rows:
                    continue
                values = pc.unique(part.column(position + 1)).drop_null()
                whole = pc.match_substring_regex(values, WHOLE)
                decimal = pc.or_(whole, pc.match_substring_regex(values, DECIMAL))
                bare = lambda some: pc.utf8_ltrim(values.filter(some), "+")
                old = kept.get((file, position), [True, True, None, None, None])
                kept[file, position] = [
                    old[0] and pc.all(whole).as_py(), old[1] and pc.all(decimal).as_py(),
                    smallest(old[2], bare(whole).cast(pa.int64()), NUMBER_SAMPLES),
                    smallest(old[3], bare(decimal).cast(pa.float64()), NUMBER_SAMPLES), smallest(old[4], values, TEXT_SAMPLES)]
    for (file, position), (whole, decimal, *samples) in kept.items():
        lists = [pa.array([x.to_pylist()], pa.list_(t)) for x, t in zip(samples, (pa.int64(), pa.float64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([position], pa.int32()), pa.array([whole]), pa.array([decimal]), *lists],
                                         names=["file", "position", "whole", "decimal", "i", "f", "s"])


def delimited_profiles(spark: SparkSession, paths: Sequence[str], sep: str) -> DataFrame:
    """``path, column, data_type, sample_values`` of headered files with one separator.

    Types are int, float and string, by all values of a column; samples are its smallest distinct values, in
    order. Empty cells are no values, and columns without any have no row; nor do files without rows. Cells
    beyond the header are left out. Headers are read first, from the first part of each file.
    """
    options = {"sep": sep, "quote": '"', "escape": '"'}
    literal = [_literal(p) for p in paths]
    place = file_key(F.col("_metadata.file_path"), encoded=True)
    lines = spark.read.text(literal).filter(F.col("_metadata.file_block_start") == 0).select(place.alias("file"), "value", F.monotonically_increasing_id().alias("line"))
    heads = lines.filter(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "line").alias("head"))
    heads = materialise(heads.withColumn("head", F.regexp_replace("head", "^\ufeff", "")), "headers")
    # One number: no header has more fields than separators and one.
    width = heads.agg(F.max(F.size(F.split("head", F.lit("[" + sep + "]"))))).first()[0]
    if width is None:
        return spark.createDataFrame([], PROFILE)
    wide = ", ".join(f"c{i} string" for i in range(width))
    names = heads.select("file", F.from_csv("head", wide, options).alias("h"))
    names = names.select("file", F.posexplode(F.array(*[F.col(f"h.c{i}") for i in range(width)])).alias("position", "column")).filter("column is not null")
    cells = spark.read.schema(wide).options(header=True, ignoreCorruptFiles=False, **options).csv(literal)
    found = cells.select(place.alias("file"), *cells.columns).mapInArrow(
        _partial, "file string, position int, whole boolean, decimal boolean, i array<bigint>, f array<double>, s array<string>")
    least = lambda c, k: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k).cast("array<string>").alias(c)
    merged = found.groupBy("file", "position").agg(
        F.bool_and("whole").alias("whole"), F.bool_and("decimal").alias("decimal"), least("i", NUMBER_SAMPLES), least("f", NUMBER_SAMPLES), least("s", TEXT_SAMPLES))
    pick = lambda i, f, s: F.when(F.col("whole"), i).when(F.col("decimal"), f).otherwise(s)
    return merged.join(names, ["file", "position"]).select(
        F.col("file").alias("path"), F.trim("column").alias("column"), pick(F.lit("int"), F.lit("float"), F.lit("string")).alias("data_type"),
        pick(F.col("i"), F.col("f"), F.col("s")).alias("sample_values"))

"""File catalogue: path tags, per-column profile, ranking of files for a question, folder trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.numbers import no_nan
from ..functions.paths import file_extension, file_name, path_components, separator_for
from ..sources.sinks import materialise
from .joins import attach
from .ranking import top_per_key
from .schema import q

# Sample sizes of a column profile, number of files picked for a question.
NUMBER_SAMPLES, TEXT_SAMPLES = 5, 10
FILES_PER_QUESTION = 5

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def catalogue_type(data_type: T.DataType) -> str:
    """The catalogue knows three types: int, float and, for everything else, string."""
    if isinstance(data_type, _INTEGRAL):
        return "int"
    return "float" if isinstance(data_type, _FRACTIONAL) else "string"


# How a column of each catalogue type travels through the sampling task.
_CARRIER = {"int": "bigint", "float": "double", "string": "string"}


_FOUND = "file string, column string, data_type string, i bigint, f double, s string"


def _smallest_per_file(k: int, kinds: dict[str, str]):
    """Arrow task: the k smallest distinct values of every column, per file, within one partition."""
    slots = {"int": "i", "float": "f", "string": "s"}
    schema = pa.schema([("file", pa.string()), ("column", pa.string()), ("data_type", pa.string()),
                        ("i", pa.int64()), ("f", pa.float64()), ("s", pa.string())])

    def smallest(values: pa.Array) -> pa.Array:
        values = pc.unique(values).drop_null()
        return values.take(pc.array_sort_indices(values)[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, str], pa.Array] = {}
        for batch in batches:
            files = pc.unique(batch.column(0))
            for file in files.to_pylist():
                part = batch if len(files) == 1 else batch.filter(pc.equal(batch.column(0), file))
                for i, name in enumerate(batch.schema.names[1:], 1):
                    values, old = part.column(i), kept.get((file, name))
                    if old is not None:
                        if len(old) == k:  # only a value below the k-th can change the sample
                            values = values.filter(pc.less(values, old[k - 1]))
                        if not len(values):
                            continue
                        values = pa.concat_arrays([old, values])
                    kept[file, name] = smallest(values)
        for (file, name), values in kept.items():
            n, slot = len(values), slots[kinds[name]]
            columns = [pa.array([x] * n, pa.string()) for x in (file, name, kinds[name])]
            columns += [values if slot == c else pa.nulls(n, schema.field(c).type) for c in ("i", "f", "s")]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _found(df: DataFrame, file: Column) -> DataFrame:
    kinds = {f.name: catalogue_type(f.dataType) for f in df.schema}
    # NaN is a missing value: kept, it would sort behind all numbers and no later number could be below it.
    carried = {c: no_nan(q(c).cast("double")) if kind == "float" else q(c).cast(_CARRIER[kind]) for c, kind in kinds.items()}
    cells = df.select(file.alias("__file"), *[v.alias(c) for c, v in carried.items()])
    return cells.mapInArrow(_smallest_per_file(TEXT_SAMPLES, kinds), _FOUND)


def _profile(found: DataFrame) -> DataFrame:
    best = top_per_key(found.distinct(), ["file", "column"], [F.col("i"), F.col("f"), F.col("s")], TEXT_SAMPLES, rank="rank")
    limited = best.filter((F.col("data_type") == "string") | (F.col("rank") <= NUMBER_SAMPLES))
    value = F.coalesce(F.col("i").cast("string"), F.col("f").cast("string"), F.col("s"))
    samples = F.array_sort(F.collect_list(F.struct("rank", value.alias("value"))))
    return limited.groupBy("file", "column", "data_type").agg(
        F.transform(samples, lambda x: x["value"]).alias("sample_values"))


def profile_columns(df: DataFrame, file: Column | None = None) -> DataFrame:
    """Per file and column: catalogue type and the smallest distinct values, in order.

    The whole table is read once. Each task reduces its rows to a few values per column before the
    shuffle, so the shuffle does not grow with the rows.
    """
    return _profile(_found(df, F.lit("") if file is None else file))


def _opened(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """A dataset with typed columns; delimited text with the separator of its suffix and inferred types."""
    if fmt == "csv":
        reader = spark.read.options(header=True, inferSchema=True, sep=separator_for(path), quote='"', escape='"', **options)
        return reader.csv(path)
    return spark.read.options(**options).format(fmt).load(path)


def _reason(e: Exception) -> str:
    """First line of an error; of one that Java threw, without the line that names the call."""
    return str(getattr(e, "java_exception", e)).split("\n")[0]


def halved(profile: Callable[[list], DataFrame], items: Sequence, reason: Callable[[Exception], str]) -> tuple[list[DataFrame], dict]:
    """Results of ``profile`` over all items, and ``{item: error}`` of those that break it. A list that breaks is
    tried again in halves: a few jobs for each broken item, however many there are in all."""
    items = list(items)
    if not items:
        return [], {}
    try:
        return [profile(items)], {}
    except Exception as e:
        if len(items) == 1:
            return [], {items[0]: reason(e)}
        (a, x), (b, y) = (halved(profile, half, reason) for half in (items[:len(items) // 2], items[len(items) // 2:]))
        return a + b, x | y


def catalogue_rows(spark: SparkSession, datasets: dict[str, str]) -> DataFrame:
    """Catalogue of datasets ``{path: format}``: path tags, name, type, column profile.

    A dataset that cannot be opened, or whose files break while they are read, keeps a row with the error text;
    one without any value keeps a row without columns.
    """
    found, failed = {}, {}
    for path, fmt in datasets.items():
        try:
            found[path] = _found(_opened(spark, path, fmt, ignoreCorruptFiles=False), F.lit(path))
        except Exception as e:  # a broken footer is no PySparkException
            failed[path] = _reason(e)
    rows = spark.createDataFrame([], "path string, column string, data_type string, sample_values array<string>")
    profile = lambda parts: materialise(_profile(reduce(DataFrame.unionByName, parts)).withColumnRenamed("file", "path"), "profiles")
    done, broken = halved(lambda paths: profile([found[p] for p in paths]), found, _reason)
    rows = reduce(DataFrame.unionByName, done, rows)
    failed |= broken
    silent = set(datasets) - set(failed) - {r[0] for r in rows.select("path").distinct().collect()}
    failed |= dict.fromkeys(sorted(silent))  # read, and without any value
    errors = spark.createDataFrame(list(failed.items()), "path string, error string")
    return with_path_tags(rows.unionByName(errors, allowMissingColumns=True), "path").withColumn("file_type", file_extension(F.col("path")))


def nested_catalogue(rows: DataFrame) -> DataFrame:
    """One row per dataset with its tags and its columns as a list of structs: the form that is stored as JSON."""
    parts = ("column", "data_type", "sample_values")
    keys = [c for c in rows.columns if c not in parts]
    column = F.when(F.col("column").isNotNull(), F.struct(*parts))
    return rows.groupBy(*[q(k) for k in keys]).agg(F.array_sort(F.collect_list(column)).alias("columns"))


def with_path_tags(df: DataFrame, path: str, skip: int = 0) -> DataFrame:
    return df.withColumns({**path_components(q(path), skip), "file_name": file_name(q(path))})


def files_per_scenario(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy(F.coalesce("scenario", F.lit("unknown")).alias("scenario")).agg(
        F.count(F.lit(1)).alias("files"))


def relevant_files(catalogue: DataFrame, question: str, columns: Column, k: int = FILES_PER_QUESTION) -> DataFrame:
    """Best files for a question: its words found among the column names, path parts and scenario.

    A word of the question counts once per place; ties fall in path order. Only files with a hit.
    """
    from .retrieval import query_terms
    asked = F.array(*[F.lit(t) for t in query_terms(question)])
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    found_in = lambda c: F.size(F.array_intersect(asked, words(c)))
    score = found_in(F.array_join(columns, " ")) + found_in(F.col("path")) + found_in(F.coalesce("scenario", F.lit("")))
    best = catalogue.withColumn("score", score.cast("bigint")).orderBy(F.desc("score"), "path").limit(k)
    return best.filter(F.col("score") > 0)


def files_by_name(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalogue rows for wanted paths: the path itself if it is catalogued, else the first path with the same
    file name. The catalogue is reduced to one path per file name first, so that a name found in every
    folder is one row of the join."""
    paths = catalogue.select("path", file_name(F.col("path")).alias("file_name"))
    names = wanted.select(F.col("path").alias("wanted"), file_name(F.col("path")).alias("file_name")).distinct()
    known = catalogue.select(F.col("path").alias("wanted")).distinct()
    exact = attach(names, known, "wanted", how="left_semi").withColumn("path", F.col("wanted"))
    others = attach(attach(names, known, "wanted", how="left_anti"), paths.groupBy("file_name").agg(F.min("path").alias("path")), "file_name", how="inner")
    return exact.unionByName(others)


def topic_texts(dictionary: DataFrame) -> DataFrame:
    """Texts of a data dictionary (table_name, category, description, position, field): one per table
    and category, its fields in position order."""
    keys = ["table_name", "category"]
    fields = dictionary.select(*keys, "description", "position", "field").distinct()
    listed = F.array_sort(F.collect_list(F.struct("position", "field")))
    lines = F.transform("f", lambda x: F.concat(F.lit("- "), x["field"], F.lit("\n")))
    return fields.groupBy(*keys).agg(F.max("description").alias("description"), listed.alias("f")).select(
        *keys, F.concat(
            F.lit("Topic: "), F.col("category"), F.lit("\nTable: "), F.col("table_name"), F.lit("\nDescription: "),
            F.coalesce("description", F.lit("")), F.lit("\nFields:\n"), F.array_join(lines, "")).alias("content"))


def folder_tree(catalogue: DataFrame, levels: list[str]) -> DataFrame:
    """Distinct folder combinations with their number of files."""
    return catalogue.groupBy(*levels).agg(F.count(F.lit(1)).alias("files"))


def folder_children(catalogue: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Distinct child folders per parent, sorted: the values of a cascading picker."""
    known = catalogue.select(*parents, child).filter(F.col(child).isNotNull()).distinct()
    return known.groupBy(*parents).agg(F.array_sort(F.collect_list(child)).alias("children"))

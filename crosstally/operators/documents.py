"""Documents: chunking, merging, validation, key phrases and quantities."""

from __future__ import annotations

import math
from collections import Counter
from heapq import nlargest
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.paths import file_extension
from ..functions.text import terms
from ..sources.sinks import materialise
from .joins import attach
from .ranking import top_per_key
from .schema import q

# Chunk sizes, file size limit, supported formats by class.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
PAGE_SIZE, PAGE_OVERLAP = 2000, 200
MAX_FILE_MB = 100
STEPS_PER_BLOCK = 64
# Most terms, the most frequent ones, whose document frequencies go to all tasks.
FREQUENT = 100_000
SUPPORTED_FORMATS = {
    "document": [".pdf", ".txt", ".doc", ".docx", ".md"],
    "spreadsheet": [".xlsx", ".csv", ".xls"],
    "audio": [".mp3", ".wav", ".m4a"],
    "video": [".mp4", ".avi", ".mov"],
}
SIZE_ERROR = "File size (%.1fMB) exceeds maximum allowed size (%.1fMB)"
TYPE_ERROR = "Unsupported file type: %s. Supported types: %s"
# A number (thousands commas and decimals allowed) followed by a percent sign or a word as its unit.
QUANTITY_PATTERN = r"[0-9][0-9,]*(\.[0-9]+)? ?(%|[A-Za-z]+)"


def chunks(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping pieces of the whole text: ``chunk_no`` from 0 and ``content``.

    A piece starts every ``size - overlap`` characters; the first piece to reach the end is the last.
    """
    step = size - overlap
    last = F.greatest(F.ceil((F.length(q(text)) - size) / F.lit(step)), F.lit(0)).cast("int")
    others = [c for c in df.columns if c != text]
    # Cut in two levels, as a substring is found by counting from the start of its text.
    blocks = F.regexp_extract_all(q(text), F.lit(f"(?s).{{1,{STEPS_PER_BLOCK * step}}}+"), F.lit(0))
    cut = df.select(*[q(c) for c in others], last.alias("__last"), F.when(q(text) == "", F.array(F.lit(""))).otherwise(blocks).alias("__blocks"))
    following = F.concat(F.slice("__blocks", 2, F.greatest(F.size("__blocks"), F.lit(1))), F.array(F.lit("")))
    wide = cut.select(*[q(c) for c in others], "__last", F.zip_with(
        "__blocks", following, lambda b, n: F.concat(b, F.left(n, F.lit(overlap)))).alias("__wide"))

    def pieces_of(block: Column, i: Column) -> Column:
        end = F.least(F.lit(STEPS_PER_BLOCK - 1), F.col("__last") - i * STEPS_PER_BLOCK)
        pieces = F.transform(F.sequence(F.lit(0), end), lambda j: F.substring(block, j * step + 1, F.lit(size)))
        return F.when(end >= 0, pieces).otherwise(F.array().cast("array<string>"))

    return wide.select(*[q(c) for c in others], F.posexplode(F.flatten(F.transform("__wide", pieces_of))).alias("chunk_no", "content"))


def merge_texts(df: DataFrame, key: str, order: str, text: str, sep: str = " ", per_part: int | None = None) -> DataFrame:
    """Texts of a document joined in order, one row per document.

    Only if ``per_part`` is given, a document comes in numbered parts of that many texts, counted by position.
    """
    items = F.array_sort(F.collect_list(F.struct(q(order).alias("o"), q(text).alias("t"))))
    content = F.array_join(F.transform(items, lambda s: s["t"]), sep).alias("content")
    if per_part is None:
        return df.groupBy(q(key)).agg(content)
    position = F.row_number().over(Window.partitionBy(q(key)).orderBy(q(order), q(text))) - 1
    return df.withColumn("part", F.floor(position / F.lit(per_part)).cast("bigint")).groupBy(q(key), "part").agg(content)


def validate_files(df: DataFrame, path: str = "path", length: str = "length", max_mb: int = MAX_FILE_MB) -> DataFrame:
    """Flag files that are too large or of an unsupported type, with the list of errors."""
    allowed = list(chain.from_iterable(SUPPORTED_FORMATS.values()))
    ext = F.when(file_extension(q(path)) != "", F.concat(F.lit("."), file_extension(q(path)))).otherwise("")
    size = q(length) / F.lit(1024.0 * 1024.0)
    errors = F.array_compact(F.array(
        F.when(size > max_mb, F.format_string(SIZE_ERROR, size, F.lit(float(max_mb)))),
        F.when(~ext.isin(*allowed), F.format_string(TYPE_ERROR, ext, F.lit(", ".join(allowed)))),
    ))
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def supported_formats(spark: SparkSession) -> DataFrame:
    rows = [(c, e) for c, exts in SUPPORTED_FORMATS.items() for e in exts]
    return spark.createDataFrame(rows, "class string, extension string")


def term_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """TF-IDF weight of every term of every document, document frequency over the whole corpus.

    Counts are combined in the map tasks. The join on the term has one row per term on one side, with
    an exchange of its own, so a frequent term can be split.
    """
    tf = df.select(q(key), F.explode(terms(q(text))).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.count(F.lit(1))).scalar()
    # Reading ``tf`` here as well keeps the plan of both uses equal: Spark counts and shuffles the terms once.
    per_term = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("total") > 0)
    idf = per_term.select(
        "term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    return attach(tf, idf, "term", how="inner").select(key, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def _heavy(idf: dict[str, float], low: float, high: float, n: int):
    """Finds ``term, tf`` of the terms of a text that may be among its ``n`` heaviest. Terms not in ``idf`` weigh between
    ``low`` and ``high`` for each time they occur; of terms of equal known weight the first ``n`` are enough."""
    def of(text: str) -> list[dict]:
        counts = Counter(text.split())
        known = sorted((-tf * idf[t], t) for t, tf in counts.items() if t in idf)
        others = [t for t in counts if t not in idf]
        best = nlargest(n, [-w for w, _ in known[:n]] + [counts[t] * low for t in others])
        # A margin for rounding.
        least = best[-1] - 1e-8 if len(best) == n else 0.0
        kept, last, equal = [], None, 0
        for w, t in known:
            equal = equal + 1 if w == last else 1
            last = w
            if -w < least:
                break
            if equal <= n:
                kept.append(t)
        kept += [t for t in others if counts[t] * high >= least]
        return [{"term": t, "tf": counts[t]} for t in kept]
    return of


def key_phrases(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """The ``n`` heaviest terms per document. Weights are compared to nine decimals so that terms
    tied but for rounding fall in alphabetical order.

    A term's documents are counted over the whole corpus. Terms are then counted row by row, and only those leave it
    that may be among the heaviest by the frequencies of the ``FREQUENT`` most frequent terms and bounds for all others;
    these are weighed exactly. Rows of a repeated key are one document and go term by term.
    """
    rows = df.select(q(key).alias("__id"), terms(q(text)).alias("__t"))
    repeated = materialise(rows.groupBy("__id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("__id").alias("__k")), "repeated-keys")
    once, merged = rows, None
    if not repeated.isEmpty():
        same = F.col("__id").eqNullSafe(F.col("__k"))
        once = rows.join(repeated, same, "left_anti")
        merged = rows.join(repeated, same, "left_semi").select("__id", F.explode("__t").alias("term")).groupBy("__id", "term").agg(F.count("*").alias("tf"))
    held = once.select(F.explode(F.array_distinct("__t")).alias("term"))
    size = df.count()
    counts = (held if merged is None else held.union(merged.select("term"))).groupBy("term").agg(F.count("*").alias("df"))
    idf = materialise(counts.select("term", (F.log((1.0 + size) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "term-weights")
    frequent = {r.term: r.idf for r in idf.orderBy("idf", "term").limit(FREQUENT).collect()}
    # A term that is not among them is no more frequent than any of them.
    shared = df.sparkSession.sparkContext.broadcast((frequent, max(frequent.values(), default=1.0), math.log((1.0 + size) / 2.0) + 1.0))

    @F.pandas_udf("array<struct<term:string,tf:bigint>>")
    def heavy(found: pd.Series) -> pd.Series:
        return found.map(_heavy(*shared.value, n))

    # Terms hold no blanks.
    candidates = once.select("__id", F.inline(heavy(F.array_join("__t", " "))))
    pairs = candidates if merged is None else candidates.union(merged)
    weights = attach(pairs, idf, "term", how="inner").select(F.col("__id").alias(key), "term", (F.col("tf") * F.col("idf")).alias("weight"))
    return top_per_key(weights, [key], [F.round("weight", 9).desc(), F.col("term")], n, rank="position")


def quantities(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(QUANTITY_PATTERN), F.lit(0))


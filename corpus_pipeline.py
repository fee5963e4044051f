"""Corpus cleaning as a chain of Spark stages: each one's result is written and read again by the next.

language ID -> quality classifier -> SimHash near-dedup -> benchmark decontamination -> BPE encoding. The first
four return the columns of ``documents`` for the rows they keep, the last one the tokens of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from crosstally.llm import bpe, decontam, langid, quality, simhash
from crosstally.sources.sinks import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A document stays if its language, and its quality, is more likely right than not.
LEAST = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, letterless, with no language more likely than not, or too unlike
    even the likeliest one (noise, languages that were not learned): more bits a byte than its own texts need."""
    known = docs.filter(~langid.held_out())
    model, limits = langid.train(known), langid.highest_rates(known)
    found = langid.predict(docs, model, into=("__language", "__language_score"), rate="__rate")
    keep = (F.col("__language") != langid.UNDETERMINED) & (F.col("__language_score") >= LEAST)
    beyond = F.lit(False)
    for language, most in limits.items():
        beyond = beyond | ((F.col("__language") == language) & (F.col("__rate") > most))
    return found.filter(keep & ~beyond).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely bad than good. Null and empty texts are judged by what else is known of
    them, ties (a score of exactly ``LEAST``) stay, repeated rows are judged alike, long texts are read whole. Without
    usable labels all scores are equal and everything stays. Other columns do not come out."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.predict(docs, model).filter(F.col("score") >= LEAST).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of documents whose three-word SimHash fingerprints are linked over three bits or
    fewer: the one with the smallest id.

    What is decided on is a text, not an id: an id with two unlike texts is in two groups and may stay with both. Of
    several texts under the smallest id the one with the smallest digest stays, of rows that repeat it the smallest.
    A group of rows without id keeps one, too. Null and empty texts are one group. Long texts are taken whole; other
    columns than those of documents do not come out.
    """
    texts = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__digest"))
    groups = simhash.groups(texts, size=3, bits=3, keep=("__digest",))
    rows = materialise(groups.groupBy("root", "doc_id", "__digest").agg(F.count("*").alias("n")), "grouped-texts")
    # Nulls sort last; of a group only the first text stays.
    first = rows.groupBy(F.col("root").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__digest")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("__digest") == F.col("first.__digest"))
    decided = rows.join(first, F.col("root") == F.col("of")).select(F.col("doc_id").alias("id"), F.col("__digest").alias("of_digest"), "n", stays.alias("stays"))
    # Few rows repeat as they are; of those that stay, all but one go.
    changed = materialise(decided.filter("not stays or n > 1"), "decided")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__digest") == F.col("of_digest"))
    # Texts are shuffled for this join at every size, and not sorted.
    alone = texts.join(changed.hint("shuffle_hash"), same, "left_anti").select(*COLUMNS)
    twice = changed.filter("stays")
    if twice.isEmpty():
        return alone
    repeated = texts.join(twice, same)
    merged = repeated.groupBy("id", "of_digest").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return alone.union(merged.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark windows in a twentieth of their words or more. Null and empty texts and, if
    there is no benchmark, all texts stay; a row goes by its own id and text, so repeats go or stay together. Long
    texts are read whole. Other columns do not come out."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = materialise(found.filter("contaminated").select(F.col("doc_id").alias("__doc"), "hash").distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("hash"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digests of ids and of the text decoded from them. Null and empty texts have none;
    each row is encoded by itself, whatever its id, repeats alike; long texts are encoded in segments."""
    coded = bpe.with_digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.drop("text")


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding", encode),
]

# No SQL for the models and the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

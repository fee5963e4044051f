"""Scores of generated answers from token overlap and TF-IDF similarity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import clamp01
from ..functions.text import is_blank, jaccard_of_sets, terms, word_set
from ..sources.sinks import materialise
from .schema import q

# The seven metrics, and the neutral score of a record without any text.
METRICS = (
    "faithfulness", "answer_relevancy", "context_precision", "context_recall",
    "context_entity_recall", "answer_similarity", "answer_correctness",
)
FOUR_METRICS = METRICS[:4]
NEUTRAL = 0.5
SLOTS = ("question", "answer", "truth", "context")


def term_similarity(df: DataFrame, ids: list[str], slots: list[str], pairs: list[tuple[str, str]],
                    keep: list[str] | None = None) -> DataFrame:
    """TF-IDF cosine between text columns of one record, the record's texts being the corpus.

    Smoothed inverse document frequency ``ln((1+n)/(1+df))+1`` over the n texts; cosine with an
    empty text is 0. ``has_terms`` tells whether any text holds a term. ``ids`` should identify a
    record; columns in ``keep`` are carried along. A row's terms are sorted and summed within the row.
    Only rows of equal ids and unlike texts are brought together, as one record of all their terms.
    """
    keep = keep or []
    n = len(slots)
    spots = {s: i for i, s in enumerate(slots)}
    needed = sorted({spots[a] for p in pairs for a in p})
    sums = [f"n{i}" for i in needed] + [f"d{spots[a]}_{spots[b]}" for a, b in pairs]
    texts = F.concat_ws(" ", *[F.coalesce(F.sha2(q(s).cast("binary"), 256), F.lit("-")) for s in slots])
    # Dealt by record, as texts are long and Spark reads a small table in one task.
    row = df.repartition(*[q(c) for c in ids]).select(*[q(c) for c in ids + keep], texts.alias("__texts"), _row_sums(slots, pairs).alias("__s"))
    rows = materialise(row.select(*[q(c) for c in ids + keep], "__texts", "__s.has_terms", *[F.col(f"__s.{c}") for c in sums]), "record-sums")
    records = rows.groupBy(*[q(c) for c in ids]).agg(
        F.min("__texts").alias("__least"), F.max("__texts").alias("__most"), *[F.first(c).alias(c) for c in ["has_terms", *keep, *sums]])
    columns = [*ids, "has_terms", *keep, *sums]
    found = records.filter("__least = __most").select(*[q(c) for c in columns])
    mixed = records.filter("__least <> __most").select(*[q(c).alias(f"__{c}") for c in ids])
    if not mixed.isEmpty():
        same = reduce(lambda a, b: a & b, [q(c).eqNullSafe(q(f"__{c}")) for c in ids])
        found = found.union(_merged_sums(df.join(mixed, same, "left_semi"), ids, slots, pairs, keep).select(*[q(c) for c in columns]))

    def cosine(a: str, b: str) -> Column:
        i, j = spots[a], spots[b]
        return F.coalesce(F.try_divide(F.col(f"d{i}_{j}"), F.sqrt(F.col(f"n{i}") * F.col(f"n{j}"))), F.lit(0.0))

    return found.select(*[q(c) for c in ids], "has_terms", *[q(c) for c in keep],
                        *[cosine(a, b).alias(f"cos_{a}_{b}") for a, b in pairs])


def _tagged(slots: list[str]) -> Column:
    """All terms of the slots' texts as (term, slot)."""
    def in_slot(i: int):
        return lambda t: F.struct(t.alias("term"), F.lit(i).alias("slot"))

    return F.flatten(F.array(*[F.transform(terms(q(s)), in_slot(i)) for i, s in enumerate(slots)]))


def _row_sums(slots: list[str], pairs: list[tuple[str, str]]) -> Column:
    """``has_terms`` and the sums of squares and products of term weights of one row: its sorted terms are read once, and
    the counts of a term are added when the next one begins."""
    n = len(slots)
    spots = {s: i for i, s in enumerate(slots)}
    products = {f"n{i}": (i, i) for i in sorted({spots[a] for p in pairs for a in p})} | {f"d{spots[a]}_{spots[b]}": (spots[a], spots[b]) for a, b in pairs}
    squares = F.array(*[F.lit((math.log((1.0 + n) / (1.0 + k)) + 1.0) ** 2) for k in range(n + 1)])

    def added(s: Column, name: str) -> Column:
        i, j = products[name]
        seen = sum((F.when(s[f"tf{m}"] > 0, 1).otherwise(0) for m in range(n)), F.lit(0))
        both = s[f"tf{i}"] * s[f"tf{j}"]
        return F.when(both > 0, s[name] + both * F.get(squares, seen)).otherwise(s[name])

    def step(s: Column, x: Column) -> Column:
        same = s["term"] == x["term"]
        return F.struct(
            x["term"].alias("term"),
            *[(F.when(same, s[f"tf{m}"]).otherwise(0.0) + F.when(x["slot"] == m, 1.0).otherwise(0.0)).alias(f"tf{m}") for m in range(n)],
            *[F.when(same, s[c]).otherwise(added(s, c)).alias(c) for c in products])

    start = F.struct(F.lit(None).cast("string").alias("term"), *[F.lit(0.0).alias(f"tf{m}") for m in range(n)], *[F.lit(0.0).alias(c) for c in products])
    return F.aggregate(F.sort_array(_tagged(slots)), start, step, lambda s: F.struct(
        s["term"].isNotNull().alias("has_terms"), *[added(s, c).alias(c) for c in products]))


def _merged_sums(df: DataFrame, ids: list[str], slots: list[str], pairs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """The same sums for records of several rows. Terms are summed per record within the map tasks before they travel."""
    n = len(slots)
    spots = {s: i for i, s in enumerate(slots)}
    long = df.select(*[q(c) for c in ids + keep], F.explode_outer(_tagged(slots)).alias("t"))
    carried = [F.first(c).alias(c) for c in keep]
    per_term = long.groupBy(*[q(c) for c in ids], F.col("t.term").alias("term")).agg(
        *[F.count_if(F.col("t.slot") == i).alias(f"tf{i}") for i in range(n)], *carried)
    seen = sum((F.when(F.col(f"tf{i}") > 0, 1).otherwise(0) for i in range(n)), F.lit(0))
    weighted = per_term.withColumn("idf", F.log((1.0 + n) / (1.0 + seen)) + 1.0)
    w = [F.col(f"tf{i}") * F.col("idf") for i in range(n)]
    needed = sorted({spots[a] for p in pairs for a in p})
    return weighted.groupBy(*[q(c) for c in ids]).agg(
        (F.count("term") > 0).alias("has_terms"),
        *[F.sum(w[i] * w[i]).alias(f"n{i}") for i in needed],
        *[F.sum(w[spots[a]] * w[spots[b]]).alias(f"d{spots[a]}_{spots[b]}") for a, b in pairs],
        *carried)


PAIRS = [("answer", "context"), ("answer", "question"), ("context", "truth"), ("answer", "truth")]


def _similarities(records: DataFrame, ids: list[str]) -> DataFrame:
    """Cosines, Jaccard scores and the number of non-blank texts of every record."""
    words = {s: F.col(f"__w_{s}") for s in SLOTS}
    sets = records.withColumns({f"__w_{s}": word_set(q(s)) for s in SLOTS})
    local = sets.select(
        *[q(c) for c in ids], *SLOTS,
        *[jaccard_of_sets(words[a], words[b]).alias(f"j_{a}_{b}") for a, b in PAIRS],
        sum((F.when(is_blank(q(s)), 0).otherwise(1) for s in SLOTS), F.lit(0)).alias("texts"))
    return term_similarity(local, ids, list(SLOTS), PAIRS, keep=["texts", *[f"j_{a}_{b}" for a, b in PAIRS]])


def fallback_scores(records: DataFrame, ids: list[str]) -> DataFrame:
    """Seven scores in 0..1 and their mean for records (question, context, truth, answer).

    TF-IDF cosine where at least two texts are given and hold terms; Jaccard alone otherwise;
    0.5 throughout when no text is given.
    """
    s = _similarities(records, ids)
    c = lambda a, b: F.col(f"cos_{a}_{b}")
    j = lambda a, b: F.col(f"j_{a}_{b}")
    full = {
        "faithfulness": c("answer", "context"), "answer_relevancy": c("answer", "question"),
        "context_precision": c("context", "truth"), "context_recall": j("context", "truth"),
        "context_entity_recall": j("context", "truth"), "answer_similarity": c("answer", "truth"),
        "answer_correctness": (c("answer", "truth") + j("answer", "truth")) / 2,
    }
    words_only = {
        "faithfulness": j("answer", "context"), "answer_relevancy": j("answer", "question"),
        "context_precision": j("context", "truth"), "context_recall": j("context", "truth"),
        "context_entity_recall": j("context", "truth"), "answer_similarity": j("answer", "truth"),
        "answer_correctness": j("answer", "truth"),
    }
    use_terms = (F.col("texts") >= 2) & F.col("has_terms")
    scored = s.select(*[q(x) for x in ids], *[
        F.when(F.col("texts") == 0, NEUTRAL).otherwise(clamp01(F.when(use_terms, full[m]).otherwise(words_only[m]))).alias(m)
        for m in METRICS])
    return scored.withColumn("overall", mean_of([F.col(m) for m in METRICS]))


def four_scores(records: DataFrame, ids: list[str], floor: float = 0.0) -> DataFrame:
    """The older four-metric variant and its mean; ``floor=0.5`` gives its first edition."""
    s = _similarities(records, ids)
    use = F.col("has_terms")
    pick = lambda a, b: F.when(use, F.col(f"cos_{a}_{b}")).otherwise(F.col(f"j_{a}_{b}"))
    raw = [pick("answer", "context"), pick("answer", "question"), pick("context", "truth"), F.col("j_context_truth")]
    scored = s.select(*[q(x) for x in ids], *[
        F.greatest(clamp01(v), F.lit(float(floor))).alias(m) for v, m in zip(raw, FOUR_METRICS)])
    return scored.withColumn("overall", mean_of([F.col(m) for m in FOUR_METRICS]))


def mean_of(columns: list[Column], failed: Column | None = None) -> Column:
    """Mean of several metrics; 0 where ``failed`` holds."""
    m = sum(columns[1:], columns[0]) / len(columns)
    return m if failed is None else F.when(failed, 0.0).otherwise(m)

"""Registered queries: scoring of generated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, measures, schema, scoring
from ..registry import query, table, texts
from .inputs import RECORDS, records, sql_strip, sql_terms, sql_with, sql_words

IDS = ["conv_id", "turn"]
SLOTS = {"question": 0, "answer": 1, "truth": 2, "context": 3}


def _jac(a: str, b: str) -> str:
    return (f"CASE WHEN len(w_{a}) = 0 OR len(w_{b}) = 0 THEN 0.0 ELSE len(list_intersect(w_{a}, w_{b}))::DOUBLE / "
            f"(len(w_{a}) + len(w_{b}) - len(list_intersect(w_{a}, w_{b}))) END")


def _cos(a: str, b: str) -> str:
    i, j = SLOTS[a], SLOTS[b]
    return (f"coalesce(sum(tf{i} * tf{j} * idf * idf) / nullif(sqrt(sum(tf{i} * tf{i} * idf * idf)) * "
            f"sqrt(sum(tf{j} * tf{j} * idf * idf)), 0), 0)")


# One row per record: word-set scores (j_*), number of texts, TF-IDF cosines (c_*).
SCORED = sql_with(RECORDS, "words AS (SELECT *, " + ", ".join(f"{sql_words(s)} AS w_{s}" for s in SLOTS) + """ FROM records),
jac AS (SELECT conv_id, turn, """ + ", ".join(f"{_jac(a, b)} AS j_{a}_{b}" for a, b in scoring.PAIRS) + ", "
    + " + ".join(f"({sql_strip(s)} <> '')::INT" for s in SLOTS) + """ AS texts FROM words),
long AS (""" + " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS slot, unnest({sql_terms(s)}) AS term FROM records" for s, i in SLOTS.items()) + """),
tf AS (SELECT conv_id, turn, term, """ + ", ".join(f"count(*) FILTER (slot = {i}) AS tf{i}" for i in range(4)) + """ FROM long GROUP BY ALL),
weighted AS (SELECT *, ln(5.0 / (1 + (tf0 > 0)::INT + (tf1 > 0)::INT + (tf2 > 0)::INT + (tf3 > 0)::INT)) + 1 AS idf FROM tf),
cosines AS (SELECT conv_id, turn, """ + ", ".join(f"{_cos(a, b)} AS c_{a}_{b}" for a, b in scoring.PAIRS) + """ FROM weighted GROUP BY ALL),
sim AS (SELECT jac.*, cosines.* EXCLUDE (conv_id, turn), cosines.conv_id IS NOT NULL AS has_terms FROM jac LEFT JOIN cosines USING (conv_id, turn))""")


def _metric(full: str, words: str) -> str:
    return f"CASE WHEN texts = 0 THEN 0.5 WHEN texts >= 2 AND has_terms THEN least(greatest({full}, 0), 1) ELSE {words} END"


METRIC_SQL = {
    "faithfulness": _metric("c_answer_context", "j_answer_context"),
    "answer_relevancy": _metric("c_answer_question", "j_answer_question"),
    "context_precision": _metric("c_context_truth", "j_context_truth"),
    "context_recall": _metric("j_context_truth", "j_context_truth"),
    "context_entity_recall": _metric("j_context_truth", "j_context_truth"),
    "answer_similarity": _metric("c_answer_truth", "j_answer_truth"),
    "answer_correctness": _metric("(c_answer_truth + j_answer_truth) / 2", "j_answer_truth"),
}
RESULTS = SCORED + ", results AS (SELECT conv_id, turn, " + ", ".join(f"{e} AS {m}" for m, e in METRIC_SQL.items()) + " FROM sim)"
MEAN = "(" + " + ".join(scoring.METRICS) + ") / 7"


def results(spark, sf):
    return scoring.fallback_scores(records(spark, sf), IDS)


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("scl4_term_similarity", SCORED + "SELECT conv_id, turn, " + ", ".join(f"round(coalesce(c_{a}_{b}, 0), 6) AS cos_{a}_{b}" for a, b in scoring.PAIRS) + " FROM sim")
def scl4(spark, sf):
    out = scoring.term_similarity(records(spark, sf), IDS, list(scoring.SLOTS), scoring.PAIRS).drop("has_terms")
    return rounded(out, [f"cos_{a}_{b}" for a, b in scoring.PAIRS])


@query("scl5_scl6_fallback_scores", RESULTS + "SELECT conv_id, turn, " + ", ".join(f"round({m}, 6) AS {m}" for m in scoring.METRICS) + f", round({MEAN}, 6) AS overall FROM results")
def scl5(spark, sf):
    return rounded(results(spark, sf), [*scoring.METRICS, "overall"])


FOUR = ("c_answer_context", "c_answer_question", "c_context_truth", "j_context_truth")


@query("scl5_four_scores_floor", SCORED + ", four AS (SELECT conv_id, turn, " + ", ".join(
    f"greatest(coalesce({e}, 0.0), 0.5) AS {m}" for e, m in zip(FOUR, scoring.FOUR_METRICS)) + " FROM sim) SELECT conv_id, turn, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in scoring.FOUR_METRICS) + f", round(({' + '.join(scoring.FOUR_METRICS)}) / 4, 6) AS overall FROM four")
def scl5_four(spark, sf):
    return rounded(scoring.four_scores(records(spark, sf), IDS, floor=0.5), [*scoring.FOUR_METRICS, "overall"])


@query("scl1_scl2_jaccard", SCORED + "SELECT conv_id, turn, round(j_answer_context, 9) AS answer_context, round(j_answer_question, 9) AS answer_question FROM sim")
def scl2(spark, sf):
    return records(spark, sf).select(
        *IDS, F.round(text.jaccard(F.col("answer"), F.col("context")), 9).alias("answer_context"),
        F.round(text.jaccard(F.col("answer"), F.col("question")), 9).alias("answer_question"))


@query("scl1_word_counts", f"SELECT doc_id, len({sql_words('text')})::BIGINT AS words FROM documents")
def scl1(spark, sf):
    return texts(spark, sf, "documents", "doc_id").select("doc_id", F.size(text.word_set(F.col("text"))).cast("bigint").alias("words"))


@query("scl3_simple_score", SCORED + """, sh AS (SELECT conv_id, turn, len(w_answer) AS n, len(w_context) AS nc, len(w_truth) AS nt,
  len(list_intersect(w_question, w_answer))::DOUBLE / nullif(len(w_answer), 0) AS q, len(list_intersect(w_context, w_answer))::DOUBLE / nullif(len(w_answer), 0) AS c,
  len(list_intersect(w_truth, w_answer))::DOUBLE / nullif(len(w_answer), 0) AS t FROM words),
s2 AS (SELECT *, CASE WHEN nc > 0 THEN (q + c) / 2 ELSE q END AS qc FROM sh)
SELECT conv_id, turn, round(least(coalesce(CASE WHEN nt > 0 THEN (qc + t) / 2 ELSE qc END, 0.0), 1.0), 9) AS score FROM s2""")
def scl3(spark, sf):
    score = text.simple_score(F.col("question"), F.col("answer"), F.array("context"), F.col("truth"))
    return records(spark, sf).select(*IDS, F.round(score, 9).alias("score"))


@query("scl7_extract_score", r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '([0-9]+\.[0-9]+|[0-9]+)', 1)[-1]::DOUBLE AS last FROM documents)
SELECT doc_id, CASE WHEN last IS NULL THEN 0.5 ELSE greatest(least(last, 1.0), 0.0) END AS score FROM n""")
def scl7(spark, sf):
    return texts(spark, sf, "documents", "doc_id").select("doc_id", text.extract_score(F.col("text")).alias("score"))


@query("scl8_score_band", RESULTS + "SELECT conv_id, turn, CASE WHEN faithfulness < 0.33 THEN 'red' WHEN faithfulness < 0.67 THEN 'yellow' ELSE 'green' END AS band FROM results")
def scl8(spark, sf):
    return results(spark, sf).select(*IDS, text.score_band(F.col("faithfulness")).alias("band"))


@query("scl9_shorten", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN text[1:4000] || '...' ELSE text END AS text FROM documents")
def scl9(spark, sf):
    return texts(spark, sf, "documents", "doc_id").select("doc_id", text.shorten(F.col("text")).alias("text"))


@query("flt9_minimum_scores", RESULTS + "SELECT conv_id, turn FROM results WHERE faithfulness >= 0.1 AND answer_relevancy >= 0.05 AND answer_correctness >= 0.02")
def flt9(spark, sf):
    return filters.at_least(results(spark, sf), {"faithfulness": 0.1, "answer_relevancy": 0.05, "answer_correctness": 0.02}).select(*IDS)


@query("agg12_mean_scores", RESULTS + "SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in scoring.METRICS) + " FROM results")
def agg12(spark, sf):
    return rounded(measures.means(results(spark, sf), list(scoring.METRICS)), scoring.METRICS)


CORR_COLUMNS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


@query("agg13_correlations", RESULTS + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM results" for a in CORR_COLUMNS for b in CORR_COLUMNS))
def agg13(spark, sf):
    return rounded(measures.correlations(results(spark, sf), CORR_COLUMNS), ["r"])


@query("agg14_constant_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) = 1 AS is_constant FROM lineitem" for c in ("l_quantity", "l_tax"))
    + " UNION ALL SELECT 'one', true")
def agg14(spark, sf):
    return measures.constant_columns(table(spark, sf, "lineitem").withColumn("one", F.lit(1.0)), ["l_quantity", "l_tax", "one"])


@query("prj18_scores_long", RESULTS + " UNION ALL ".join(
    f"SELECT conv_id, turn, '{m}' AS metric, round({m}, 6) AS score FROM results" for m in CORR_COLUMNS))
def prj18(spark, sf):
    return rounded(schema.to_long(results(spark, sf), IDS, CORR_COLUMNS), ["score"])

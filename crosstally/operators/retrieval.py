"""Retrieval: vector, keyword and hybrid top-k, context blocks, citations, facets, chat context.

Queries are parameters of a request (a few vectors or texts), never a table, so scoring is one
pass over the corpus; top-k is cut per map task before anything is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import strip
from ..functions.paths import file_name
from ..functions.payload import parse_payload
from ..functions.text import TERM_CHARACTER, TERM_PATTERN
from .joins import figures
from .ranking import sorted_pages, top_per_key
from .schema import q

# Result counts and text limits of a request; wording of contexts and citations.
VECTOR_HITS, TEXT_HITS = 20, 5
ANSWER_HITS, ANSWER_CHARS = 3, 1000
SUMMARY_HITS, SUMMARY_CHARS = 2, 200
CHAT_TURNS = 10
NO_PAGE = "N/A"
SOURCE_LINE, ANSWER_SOURCE, SUMMARY_SOURCE = "**Sources:** ", "Source ", "From "
QUESTION_LINE, ANSWER_LINE, CHARTS_LINE = "Previous Question: ", "Previous Answer: ", "Previous Charts: "
# Usual parameters of the BM25 ranking function and of reciprocal rank fusion.
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays, in double precision; null when one has no length."""
    mul = lambda x, y: F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total(mul(a, b)), F.sqrt(total(mul(a, a))) * F.sqrt(total(mul(b, b))))


def vector_hits(df: DataFrame, key: str, vector: str, queries: dict[str, list[float]], k: int = VECTOR_HITS) -> DataFrame:
    """Nearest ``k`` rows per query vector by cosine: ``query, key, score, position``.

    Filter ``df`` beforehand to restrict by metadata. Scores are compared to nine decimals,
    ties fall in key order.
    """
    scored = []
    c = lambda x: x.cast("double")
    norm = F.sqrt(F.aggregate(q(vector), F.lit(0.0), lambda s, v: s + c(v) * c(v)))
    for name, values in queries.items():
        length = math.sqrt(sum(v * v for v in values))
        unit = F.array(*[F.lit(v / length) for v in values])
        dot = F.aggregate(F.zip_with(q(vector), unit, lambda u, v: c(u) * v), F.lit(0.0), lambda s, v: s + v)
        scored.append(F.struct(F.lit(name).alias("query"), F.try_divide(dot, norm).alias("score")))
    long = df.select(q(key), F.inline(F.array(*scored))).filter(F.col("score").isNotNull())
    return top_per_key(long, ["query"], [F.round("score", 9).desc(), q(key)], k, rank="position")


def query_terms(text: str) -> list[str]:
    """Distinct terms of a query text, first occurrence first."""
    found = re.findall(r"\w{2,}", text.lower())
    return list(dict.fromkeys(found))


def keyword_hits(df: DataFrame, key: str, text: str, queries: dict[str, str], k: int = TEXT_HITS) -> DataFrame:
    """Best ``k`` rows per query text by BM25: ``query, key, score, position``.

    Only the query's own terms are taken from each row, so no term table is built or shuffled.
    Document frequencies and the mean length come from one aggregation, read as a scalar subquery.
    """
    wanted = list(dict.fromkeys(t for s in queries.values() for t in query_terms(s)))
    lowered = F.lower(F.coalesce(q(text), F.lit("")))
    any_term = "|".join(map(re.escape, wanted))
    whole_term = f"(?<!{TERM_CHARACTER})({any_term})(?!{TERM_CHARACTER})"
    found = F.regexp_extract_all(lowered, F.lit(whole_term), F.lit(1)).alias("found")
    length = F.regexp_count(lowered, F.lit(TERM_PATTERN)).alias("len")
    stats = figures(
        df.select(length, found), n=F.count(F.lit(1)), avg_len=F.avg("len"),
        **{f"df{i}": F.count_if(F.array_contains("found", t)) for i, t in enumerate(wanted)})
    # A plain search for any query term spares taking apart texts that cannot score.
    likely = df.filter(lowered.rlike(any_term)).select(q(key), length, found)
    rows = likely.select(q(key), "len", stats.alias("s"), *[
        (F.size("found") - F.size(F.array_remove("found", t))).alias(f"tf{i}") for i, t in enumerate(wanted)])

    def part(i: int) -> Column:
        tf, df_ = F.col(f"tf{i}"), F.col(f"s.df{i}")
        idf = F.log(1.0 + (F.col("s.n") - df_ + 0.5) / (df_ + 0.5))
        return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("s.avg_len")))

    per_query = [F.struct(F.lit(name).alias("query"),
                          sum((part(wanted.index(t)) for t in query_terms(s)), F.lit(0.0)).alias("score"))
                 for name, s in queries.items()]
    long = rows.select(q(key), F.inline(F.array(*per_query))).filter(F.col("score") > 0)
    return top_per_key(long, ["query"], [F.round("score", 9).desc(), q(key)], k, rank="position")


def fuse(keyword: DataFrame, vector: DataFrame | None, key: str, k: int = TEXT_HITS) -> DataFrame:
    """Reciprocal rank fusion of two hit lists; keyword hits alone when there is no vector list."""
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    kw = keyword.select("query", q(key), F.col("position").alias("keyword_rank"))
    if vector is None:
        joined = kw.withColumn("vector_rank", F.lit(None).cast("int"))
    else:
        vec = vector.select("query", q(key), F.col("position").alias("vector_rank"))
        joined = kw.join(vec, ["query", key], "full_outer")
    scored = joined.withColumn("score", part("keyword_rank") + part("vector_rank"))
    return top_per_key(scored, ["query"], [F.round("score", 9).desc(), q(key)], k, rank="position")


def _joined(df: DataFrame, group: str, order: str, text: Column, sep: str, out: str) -> DataFrame:
    """Texts of a hit list joined in rank order; hit lists are short by construction (top k)."""
    rows = F.array_sort(F.collect_list(F.struct(q(order).alias("o"), text.alias("t"))))
    return df.groupBy(q(group)).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias(out))


def context_block(hits: DataFrame, group: str = "query", order: str = "position") -> DataFrame:
    """Per query one text with source, page, content and score of every hit, in rank order."""
    source = F.when(F.coalesce(F.length("location"), F.lit(0)) > 0, file_name(F.col("location"))).otherwise("Unknown")
    text = F.concat(
        F.lit("Source: "), source, F.lit("\nPage: "), F.coalesce(F.col("page").cast("string"), F.lit(NO_PAGE)),
        F.lit("\nContent: "), F.col("content"), F.lit("\nRelevance Score: "), F.col("score").cast("string"), F.lit("\n---"))
    return _joined(hits, group, order, text, "\n\n", "context")


def answer_context(hits: DataFrame, group: str = "query", order: str = "position",
                   n: int = ANSWER_HITS, chars: int = ANSWER_CHARS) -> DataFrame:
    """Numbered sources for an answer: the first hits, shortened."""
    text = F.concat(F.lit(ANSWER_SOURCE), q(order).cast("string"), F.lit(" ("), F.col("bank"), F.lit(" - "),
                    F.col("file_name"), F.lit("):\n"), F.left("content", F.lit(chars)))
    return _joined(hits.filter(q(order) <= n), group, order, text, "\n\n", "context")


def answer_summary(hits: DataFrame, group: str = "query", order: str = "position") -> DataFrame:
    """Plain summary when no answer could be written: opening words of the first hits."""
    text = F.concat(F.lit(SUMMARY_SOURCE), F.col("bank"), F.lit(": "), F.left("content", F.lit(SUMMARY_CHARS)), F.lit("..."))
    return _joined(hits.filter(q(order) <= SUMMARY_HITS), group, order, text, "\n\n", "summary")


def _page_label(c: Column) -> Column:
    """Page as text: whole numbers without fraction, missing pages as N/A."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit(NO_PAGE))


def citations(refs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per document its distinct pages in number order: ``doc, pages, citation``.

    Distinct pages are found before they are collected, so repeats cost nothing.
    """
    group = group or []
    doc = file_name(F.col("location"))
    pages = refs.filter(F.length("location") > 0).select(
        *[q(g) for g in group], doc.alias("doc"), _page_label(F.col("page")).alias("page")).distinct()
    return pages.groupBy(*[q(g) for g in group], "doc").agg(
        F.array_join(sorted_pages(F.collect_list("page")), ", ").alias("pages")
    ).withColumn("citation", F.concat("doc", F.lit(" (Page "), "pages", F.lit(")")))


def citation_line(cited: DataFrame, group: str) -> DataFrame:
    """One source line per query, documents in alphabetical order. ``cited`` comes from the hits of
    a query, so a group is at most as long as its hit list."""
    names = F.array_sort(F.collect_list("citation"))
    return cited.groupBy(q(group)).agg(F.concat(F.lit(SOURCE_LINE), F.array_join(names, ", ")).alias("sources"))


def citation_list(refs: DataFrame) -> DataFrame:
    """Distinct 'document (Page n)' entries."""
    return refs.select(F.concat(file_name(F.col("location")), F.lit(" (Page "), _page_label(F.col("page")), F.lit(")"))
                       .alias("source")).distinct()


def facet_counts(hits: DataFrame, facets: list[str]) -> DataFrame:
    """Hits per value of every facet; array facets count each element. One scan for all facets."""
    types = dict(hits.dtypes)

    def entries(f: str) -> Column:
        elements = q(f) if types[f].startswith("array") else F.array(q(f))
        return F.transform(elements, lambda v: F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")))

    values = F.flatten(F.array(*[entries(f) for f in facets]))
    return hits.select(F.inline(values)).filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("hits"))


def chat_context(turns: DataFrame, group: str = "conv_id", order: str = "turn", role: str = "role",
                 text: str = "text", last: int = CHAT_TURNS, reply=None) -> DataFrame:
    """Question/answer pairs among the last turns of a conversation as one text.

    The last turns are cut per map task first, so at most ``last`` rows of a conversation meet.
    Turns pair by position: the 1st with the 2nd, the 3rd with the 4th, and so on, counted from the
    oldest turn kept; pairs that are not user then assistant are left out. ``reply`` turns an assistant's
    text into its line (:func:`json_reply` reads JSON answers and sums up charts); else the text is quoted.
    """
    said = (reply or (lambda c: F.concat(F.lit(ANSWER_LINE), c)))(q(text))
    recent = top_per_key(turns, [group], [q(order).desc()], last, rank="back").withColumn(
        text, F.when(q(role) == "assistant", said).otherwise(q(text)))
    listed = F.array_sort(F.collect_list(F.struct(q(order).alias("o"), q(role).alias("r"), q(text).alias("t"))))
    rows = recent.groupBy(q(group)).agg(listed.alias("m"))
    numbered = F.transform("m", lambda x, i: F.struct(i.alias("i"), x["r"].alias("r"), x["t"].alias("t")))
    pair = lambda x: F.get(F.col("m"), x["i"] + 1)
    good = F.filter(numbered, lambda x: (x["i"] % 2 == 0) & (x["r"] == "user")
                    & F.coalesce(pair(x)["r"] == "assistant", F.lit(False)))
    text_of = lambda x: F.concat(F.lit(QUESTION_LINE), x["t"], F.lit("\n\n"), pair(x)["t"])
    return rows.select(q(group), F.array_join(F.transform(good, text_of), "\n\n").alias("context"))


def json_reply(c: Column) -> Column:
    """History line of an assistant turn that may be a JSON payload, with a summary of its charts."""
    return reply_history(c, parse_payload(c), with_charts=True)


def chart_summary(charts: Column) -> Column:
    """'Chart 1: 2 columns, 5 rows, …' of a payload's charts."""
    return F.array_join(F.transform(charts, lambda c, i: F.concat(
        F.lit("Chart "), (i + 1).cast("string"), F.lit(": "), F.size(c["header"]).cast("string"), F.lit(" columns, "),
        F.size(c["rows"]).cast("string"), F.lit(" rows"))), ", ")


def reply_history(c: Column, payload: Column, with_charts: bool = False) -> Column:
    """History text of an assistant turn: its JSON answer if it has one, else the turn itself."""
    answer = F.concat(F.lit(ANSWER_LINE), F.coalesce(payload["answer"], strip(c)))
    if not with_charts:
        return answer
    charts = payload["chart_data"]
    return F.when(F.coalesce(F.size(charts), F.lit(0)) > 0,
                  F.concat(answer, F.lit("\n\n" + CHARTS_LINE), chart_summary(charts))).otherwise(answer)

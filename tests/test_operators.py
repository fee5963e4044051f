"""Operators on small literal frames and against brute force; skewed inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from crosstally.operators import (catalogue, documents, filters, joins, measures, ranking, reconcile, register, retrieval,
                                  schema, scoring, transforms)
from tests.conftest import rows


def letters(spark, text):
    return spark.createDataFrame([(c,) for c in text], "join_key string")


def test_venn_of_smoke_sets(spark):
    scored = spark.createDataFrame([("a", 60), ("b", 40), ("g", 70), ("h", 80), ("d", 55), ("f", 20)], "join_key string, p int")
    sets = {"A": letters(spark, "abcdef"), "B": scored.filter("p >= 50").select("join_key"), "C": letters(spark, "cdeijf")}
    want = {"A": 1, "B": 2, "C": 2, "A+B": 1, "A+C": 3, "B+C": 0, "A+B+C": 1}
    assert dict(rows(reconcile.venn_regions(sets))) == want
    assert dict(rows(reconcile.venn_from_sizes(reconcile.set_sizes(sets), "A", "B", "C"))) == want


def test_missing_keys_never_match(spark):
    l = spark.createDataFrame([("x", None), ("y", "K")], "id string, k string")
    r = spark.createDataFrame([("z", None), ("w", " k\t")], "id string, k string")
    a, b = reconcile.keyed(l, "k"), reconcile.keyed(r, "k")
    assert rows(reconcile.side_counts(a, b)) == [("both", 1), ("left_only", 0), ("right_only", 0)]
    kept = reconcile.keyed(l, "k", drop_missing=False)
    assert kept.count() == 2
    assert reconcile.only_left(kept, b).select("id").collect()[0][0] == "x"
    assert reconcile.only_left(kept, b, keep_missing=False).count() == 0


def test_compare_counts_equal_full_outer_join(spark):
    rnd = random.Random(1)
    # One key holds a third of both sides.
    ks = lambda n, lo: [("hot" if rnd.random() < 0.33 else f"k{rnd.randint(lo, lo + 40)}",) for _ in range(n)]
    left, right = ks(300, 0), ks(200, 20)
    pl, pr = pd.DataFrame(left, columns=["join_key"]), pd.DataFrame(right, columns=["join_key"])
    want = Counter(pl.merge(pr, how="outer", on="join_key", indicator=True)["_merge"].astype(str))
    l, r = (spark.createDataFrame(x, "join_key string") for x in (left, right))
    assert {s: n for s, n in rows(reconcile.side_counts(l, r))} == {s: want.get(s, 0) for s in ("both", "left_only", "right_only")}
    full = reconcile.compare_rows(l.withColumn("side_l", F.lit(1)), r)
    assert full.count() == len(left) + sum(1 for (k,) in right if (k,) not in set(left))


def test_flags_compare_against_whole_list(spark):
    l = spark.createDataFrame([("a", "Y"), ("b", "N"), ("b", "N")], "join_key string, f string")
    r = spark.createDataFrame([("b",), ("c",)], "join_key string")
    got = rows(reconcile.compare_counts_by_flag(l, r, "f", ["Y", "N"]))
    assert got == sorted([("N", "both", 2, 1), ("N", "right_only", 1, 1), ("Y", "left_only", 1, 1), ("Y", "right_only", 2, 2)], key=repr)


def test_reconcile_tables(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (3, 3.0, "y")], "id int, v double, t string")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, "x"), (4, 4.0, "z")], "id int, v double, t string")
    got = {r["id"]: (r["outcome"], r["differing"]) for r in reconcile.reconcile_tables(a, b, "id", ["v", "t"]).collect()}
    assert got[1] == ("match", []) and got[2] == ("mismatch", ["v"])
    assert got[3][0] == "missing_right" and got[4][0] == "missing_left"


def test_latest_per_key_null_order(spark):
    d = spark.createDataFrame([("a", None, 1), ("a", "2024-01-01", 2), ("a", "2024-02-01", 3), ("b", None, 4)], "k string, d string, id int")
    last = ranking.latest_per_key(d, "k", "d", [F.col("id")])
    first = ranking.latest_per_key(d, "k", "d", [F.col("id")], nulls="first")
    assert rows(last.select("k", "id")) == [("a", 3), ("b", 4)]
    assert rows(first.select("k", "id")) == [("a", 1), ("b", 4)]


def test_top_per_key_prunes_before_the_shuffle(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.top_per_key(d, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_fan_out_join_equals_left_join(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, k string")
    r = spark.createDataFrame([("a", 10), ("a", 11), ("c", 12)], "key string, v int")
    assert rows(joins.fan_out_join(l, r, "k", "key").select("id", "k", "v")) == sorted(
        [(1, "a", 10), (1, "a", 11), (2, "b", None), (3, None, None), (4, "a", 10), (4, "a", 11)], key=repr)


def test_salted_totals_keep_every_row(spark):
    d = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 != 0, "cold").alias("k"), F.col("id").alias("v"))
    t = d.groupBy("k").agg(F.count("*").alias("n"))
    got = joins.salted_totals(d, t, ["k"], F.col("v"))
    assert got.count() == 500
    assert rows(got.groupBy("k").agg(F.max("n"), F.count("*"))) == rows(t.select("k", "n", "n"))


@pytest.mark.parametrize("most", [3, 50, 4096])
def test_quantiles_are_exact(spark, most):
    rnd = np.random.default_rng(3)
    # A third of all values are one and the same; another group is tiny.
    data = [("g", float(x)) for x in np.where(rnd.random(3000) < 0.33, 5.0, rnd.normal(5, 3, 3000).round(2))] + [("h", 1.0), ("h", 2.0)]
    d = spark.createDataFrame(data + [("g", None), (None, 7.0)], "k string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["p"]): r["value"] for r in measures.quantiles(d, ["k"], "x", probs, most).collect()}
    for k in ("g", "h"):
        values = [x for n, x in data if n == k]
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(values, p)), (k, p)
    assert got[None, 0.5] == 7.0


def test_quantiles_of_a_large_group_rank_few_values(spark):
    """A million distinct values of every order of size, half of all rows one value; two rounds leave few to rank."""
    n = 1_000_000
    d = spark.range(2 * n).select(F.lit("g").alias("k"), F.when(F.col("id") < n, F.exp(F.col("id") / 5000.0)).otherwise(F.exp(F.lit(100.0))).alias("x"))
    got = {r.p: r.value for r in measures.quantiles(d, ["k"], "x", [0.1, 0.5, 0.8], 500).collect()}
    values = np.concatenate([np.exp(np.arange(n) / 5000.0), np.full(n, np.exp(100.0))])
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(values, p), rel=1e-9)
    assert len(got) == 3 and measures.quantiles(d.limit(0), ["k"], "x", [0.5]).count() == 0


def test_box_statistics(spark):
    d = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 5, 100]], "k string, x double")
    r = measures.box_statistics(d, ["k"], "x").collect()[0]
    assert (r["q1"], r["median"], r["q3"], r["min"], r["max"], r["lower_fence"], r["upper_fence"]) == (2.25, 3.5, 4.75, 1, 100, 1, 5)


def test_correlations_match_pandas_and_guard_constants(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None], "b": [2.0, 1, 4, 3, 9], "c": [0.1] * 5})
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in measures.correlations(d, ["a", "b", "c"]).collect()}
    want = pdf.corr()
    assert got["a", "b"] == pytest.approx(want.loc["a", "b"]) and got["a", "a"] == pytest.approx(1.0)
    assert got["a", "c"] is None and got["c", "c"] is None and len(got) == 9


def test_range_counts_edges(spark):
    d = spark.createDataFrame([(0.0,), (-5.0,), (1e6,), (1e6 + 1,), (2e10,), (None,)], "x double")
    assert [(r["label"], r["rows"]) for r in measures.range_counts(d, "x").orderBy("position").collect()] == [
        ("<1M", 1), ("1M-10M", 1), ("10M-100M", 0), ("100M-1B", 0), ("1B-10B", 0), (">10B", 1)]


def test_histogram_top_edge(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.05, 1.0, 1.1)], "x double")
    assert [(r["bin"], r["rows"]) for r in measures.histogram(d, "x", 20, 0.0, 1.0).orderBy("bin").collect()] == [(0, 1), (1, 1), (19, 1)]
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r["bin"], r["rows"]) for r in measures.histogram_over_range(one, "x", 10).collect()] == [(0, 2)]


def test_empty_sum_and_null_group(spark):
    d = spark.createDataFrame([("a", None), (None, 1.0)], "k string, v double")
    assert rows(measures.sum_by(d, ["k"], "v")) == [("a", 0.0)]
    assert rows(measures.count_by(d, "k", keep_missing=True)) == [("a", 1), (None, 1)]


def test_hierarchy_levels(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), ("b", "x", 4.0)], "o string, i string, v double")
    got = rows(measures.hierarchical_totals(d, "o", "i", "v"))
    assert ("a", None, 2.0, 0) in got and ("a", None, 3.0, 1) in got and (None, None, 7.0, 2) in got


def test_eligibility(spark):
    d = spark.createDataFrame([(True, "Active", "C1", None, None), (True, "Active", None, "G1", "V2"), (True, None, "C1", "G1", "V1"),
                               (False, "Active", "C1", "G1", "V1"), (True, "Active", None, None, None)],
                              "reg boolean, st string, con string, gov string, via string")
    c = F.col
    broad = d.filter(filters.eligible_broad(c("reg"), c("st"), c("con"), c("gov"), c("via"))).count()
    strict = d.filter(filters.eligible_strict(c("reg"), c("st"), c("gov"), c("via"))).count()
    assert (broad, strict) == (2, 1)
    with pytest.raises(ValueError):
        filters.in_runs(d, "adverse", ["r"] * 5)


def test_schema_tools(spark):
    d = spark.createDataFrame([(1, "a")], "` 'No.' ` int, `Name of provider` string")
    d = schema.rename_containing(schema.clean_header(d), "PROVIDER", "Provider")
    assert d.columns == ["No.", "Provider"]
    wanted = T.StructType([T.StructField("Provider", T.StringType()), T.StructField("No.", T.LongType()), T.StructField("Route", T.StringType())])
    assert rows(schema.conform(d, wanted)) == [("a", 1, None)]
    with pytest.raises(ValueError, match="Route"):
        schema.require_columns(d, ["Route"])
    assert schema.expand_code_ranges({"31-33": "M", "42": "W"}) == {"31": "M", "32": "M", "33": "M", "42": "W"}


def _tfidf(texts):
    """Cosine matrix by the textbook definition."""
    import re
    toks = [re.findall(r"\w{2,}", t.lower()) for t in texts]
    n = len(texts)
    df = Counter(t for ts in toks for t in set(ts))
    vec = [{t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(ts).items()} for ts in toks]
    norm = [math.sqrt(sum(v * v for v in x.values())) for x in vec]
    return [[sum(v * y.get(t, 0) for t, v in x.items()) / (a * b) if a and b else 0.0 for y, b in zip(vec, norm)] for x, a in zip(vec, norm)]


def test_fallback_scores_against_brute_force(spark):
    data = [(1, "what is green revenue", "green revenue is money", "revenue from green sources", "green money is revenue é éa"),
            (2, "", "", "", ""), (3, "one text only", " ", "", ""), (4, "a b", "b c", "x", "y"), (5, "été chaud", "Été froid", "", "hiver froid")]
    d = spark.createDataFrame(data, "id int, question string, answer string, truth string, context string")
    got = {r["id"]: r.asDict() for r in scoring.fallback_scores(d, ["id"]).collect()}

    def jac(a, b):
        x, y = set(a.lower().split()), set(b.lower().split())
        return len(x & y) / len(x | y) if x and y else 0.0

    for i, q, a, t, c in (data[0], data[4]):
        m = _tfidf([q, a, t, c])
        want = [m[1][3], m[1][0], m[3][2], jac(c, t), jac(c, t), m[1][2], (m[1][2] + jac(a, t)) / 2]
        assert [got[i][k] for k in scoring.METRICS] == pytest.approx(want)
        assert got[i]["overall"] == pytest.approx(sum(want) / 7)
    assert all(got[2][m] == 0.5 for m in scoring.METRICS)
    assert all(got[3][m] == 0.0 for m in scoring.METRICS)
    assert got[4]["answer_relevancy"] == pytest.approx(1 / 3)  # no terms of two letters: words alone
    four = {r["id"]: r for r in scoring.four_scores(d, ["id"], floor=0.5).collect()}
    assert four[1]["context_recall"] == max(0.5, jac(data[0][4], data[0][3]))


def test_mean_of_failed_rows(spark):
    d = spark.createDataFrame([(1.0, 0.5, False), (1.0, 0.5, True)], "a double, b double, bad boolean")
    got = d.select(scoring.mean_of([F.col("a"), F.col("b")], F.col("bad")).alias("m")).collect()
    assert [r["m"] for r in got] == [0.75, 0.0]


def test_described_fields(spark):
    d = spark.createDataFrame([(1, ["b", "x", "a"]), (2, [])], "id int, f array<string>")
    words = spark.createDataFrame([("a", "A"), ("b", "B")], "field string, description string")
    got = schema.describe_fields(d, "id", "f", words).collect()
    assert [(r["id"], [tuple(x) for x in r["described"]]) for r in got] == [(1, [("b", "B"), ("a", "A")])]


def test_frequent_fields_do_not_travel(spark):
    """An unknown and a known field of most rows are not shuffled for the lookup."""
    d = spark.createDataFrame([(i, ["none", f"f{i % 50}", "often", None]) for i in range(200)], "id int, f array<string>")
    words = spark.createDataFrame([(f"f{i}", f"F{i}") for i in range(0, 50, 2)] + [("often", "O")], "field string, description string")
    found = schema.describe_fields(d, "id", "f", words)
    got = {r["id"]: [tuple(x) for x in r["described"]] for r in found.collect()}
    assert got == {i: [(f"f{i % 50}", f"F{i % 50}")] * (i % 2 == 0) + [("often", "O")] for i in range(200)}
    plan = found._jdf.queryExecution().toString()
    assert "none" in plan and "broadcast" in plan
    empty = schema.describe_fields(d.filter("false"), "id", "f", words)
    assert empty.count() == 0


def test_terms_are_summed_within_rows(spark):
    """No row a term; rows of equal ids and unlike texts are one record, equal ones count once."""
    rows_ = [(1, "red car", "a red car", "car", "the red car"), (2, "", "", "", ""), (3, "x1 y1", "y1 y1 z1", "", None)]
    names = "id int, question string, answer string, truth string, context string"
    d = spark.createDataFrame(rows_, names)
    found = scoring.term_similarity(d, ["id"], list(scoring.SLOTS), scoring.PAIRS)
    assert "Generate" not in found._jdf.queryExecution().toString()
    of = lambda df: {r["id"]: tuple(round(v, 9) for v in r[1:]) for r in scoring.term_similarity(df, ["id"], list(scoring.SLOTS), scoring.PAIRS).collect()}
    once = of(d)
    assert of(d.union(d)) == once and once[2] == (False, 0, 0, 0, 0)
    halves = spark.createDataFrame([(3, "x1", "y1", "", None), (3, "y1", "y1 z1", "", None), rows_[0], rows_[1]], names)
    assert of(halves) == once


def test_chunks_cover_the_text(spark):
    texts = ["", "x" * 999, "y" * 1000, "z" * 1001, "".join(chr(97 + i % 26) for i in range(4321))]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = defaultdict(list)
    for r in documents.chunks(d, "text").orderBy("id", "chunk_no").collect():
        got[r["id"]].append(r["content"])
    assert [len(got[i]) for i in range(5)] == [1, 1, 1, 2, 6]
    step = lambda t: [t[i:i + 1000] for i in range(0, max(len(t) - 1000, 0) + 800, 800)][:max(-(-(len(t) - 1000) // 800), 0) + 1]
    assert all(got[i] == step(t) for i, t in enumerate(texts))
    long = "".join(chr(97 + i % 26) if i % 7 else "😀" for i in range(130_001))
    for n in (51_199, 51_200, 51_201, 51_400, 130_001):
        pieces = [r["content"] for r in documents.chunks(spark.createDataFrame([(1, long[:n])], "id int, text string"), "text").orderBy("chunk_no").collect()]
        assert pieces == step(long[:n]), n
    whole = got[4]
    assert whole[0] + "".join(c[200:] for c in whole[1:]) == texts[4]


def test_merge_texts(spark):
    d = spark.createDataFrame([("d", n * 1000, str(n)) for n in range(25)], "k string, o int, t string")
    (whole,) = documents.merge_texts(d, "k", "o", "t", sep=",").collect()
    assert whole["content"] == ",".join(str(n) for n in range(25))
    got = documents.merge_texts(d, "k", "o", "t", per_part=10, sep=",").orderBy("part").collect()
    assert ",".join(r["content"] for r in got) == ",".join(str(n) for n in range(25)) and len(got) == 3


def test_key_phrases(spark):
    d = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, "pear")], "id int, text string")
    got = rows(documents.key_phrases(d, "id", "text", 1).select("id", "term"))
    assert got == [(1, "apple"), (2, "plum"), (3, "pear")]


def test_key_phrases_are_those_of_all_weights(spark, monkeypatch):
    """With bounds for all but three terms, ties, repeated and missing keys; few terms leave their row."""
    rng = random.Random(5)
    texts = [(i if i < 55 else 7 if i < 58 else None, " ".join(rng.choices([f"w{j}" for j in range(30)], [1 / (1 + j) for j in range(30)], k=rng.randint(0, 25)))) for i in range(60)]
    d = spark.createDataFrame(texts + [(99, None)], "id int, text string")
    order = [F.round("weight", 9).desc(), F.col("term")]
    want = rows(ranking.top_per_key(documents.term_weights(d, "id", "text"), ["id"], order, 3, rank="position").withColumn("weight", F.round("weight", 9)))
    for frequent in (documents.FREQUENT, 3, 1):
        monkeypatch.setattr(documents, "FREQUENT", frequent)
        assert rows(documents.key_phrases(d, "id", "text", 3).withColumn("weight", F.round("weight", 9))) == want
    of = documents._heavy({t: 2.0 for t in "abcdefgh"}, 2.5, 9.0, 2)
    assert of("a b c d e f g h") == [{"term": "a", "tf": 1}, {"term": "b", "tf": 1}]
    assert of("a a a a a b z") == [{"term": "a", "tf": 5}, {"term": "z", "tf": 1}] and of("") == []


def test_vector_hits_against_numpy(spark):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(200, 16)).astype("float32")
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, v array<float>")
    d = d.union(spark.createDataFrame([(999, [0.0] * 16)], "id int, v array<float>"))
    query = [float(x) for x in rnd.normal(size=16)]
    cos = v @ np.array(query) / (np.linalg.norm(v, axis=1) * np.linalg.norm(query))
    got = retrieval.vector_hits(d, "id", "v", {"q": query}, 7).orderBy("position").collect()
    assert [r["id"] for r in got] == list(np.argsort(-cos)[:7])
    assert [r["score"] for r in got] == pytest.approx(sorted(cos, reverse=True)[:7], abs=1e-6)


def test_keyword_hits_against_brute_force(spark):
    import re
    texts = ["red apple red", "green apple pie with apple", "nothing", "RED wine", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    toks = [re.findall(r"\w{2,}", t.lower()) for t in texts]
    n, avg = len(texts), sum(map(len, toks)) / len(texts)

    def bm25(query, ts):
        s = 0.0
        for t in query:
            df = sum(t in x for x in toks)
            tf = ts.count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        return s

    got = retrieval.keyword_hits(d, "id", "text", {"q": "red Apple", "none": "zebra"}, 5).orderBy("position").collect()
    want = sorted(((bm25(["red", "apple"], ts), i) for i, ts in enumerate(toks)), key=lambda x: (-x[0], x[1]))
    assert [r["id"] for r in got] == [i for s, i in want if s > 0]
    assert [r["score"] for r in got] == pytest.approx([s for s, _ in want if s > 0])
    fused = retrieval.fuse(retrieval.keyword_hits(d, "id", "text", {"q": "red"}, 5), None, "id", 1).collect()
    assert [r["id"] for r in fused] == [0]


def test_chat_context(spark):
    turns = [("a", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(14)] + [("s", 0, "system", "x"), ("s", 1, "user", "q"), ("s", 2, "assistant", "r")]
    d = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    got = dict(rows(retrieval.chat_context(d)))
    assert got["a"].startswith("Previous Question: t4\n\nPrevious Answer: t5\n\nPrevious Question: t6") and got["a"].endswith("t13")
    assert got["s"] == ""  # pairs by position: system first shifts the pairing


def test_page_order_and_citations(spark):
    refs = spark.createDataFrame([("s/a.pdf", 10.0), ("s/a.pdf", 2.0), ("s/a.pdf", None), ("s/a.pdf", 2.0), ("", 1.0)], "location string, page double")
    got = retrieval.citations(refs).collect()
    assert [(r["doc"], r["pages"], r["citation"]) for r in got] == [("a.pdf", "2, 10, N/A", "a.pdf (Page 2, 10, N/A)")]


def test_facets_and_reply_history(spark):
    d = spark.createDataFrame([("en", ["a", "b"]), ("en", ["a"]), (None, None)], "lang string, tags array<string>")
    assert rows(retrieval.facet_counts(d, ["lang", "tags"])) == [("lang", "en", 2), ("tags", "a", 2), ("tags", "b", 1)]
    from crosstally.functions.payload import parse_payload
    h = spark.createDataFrame([('{"answer": "yes", "chart_data": [{"header": ["a","b"], "rows": [["x","1"]]}]}',), ("plain",)], "t string")
    got = [r[0] for r in h.select(retrieval.reply_history(F.col("t"), parse_payload(F.col("t")), True)).collect()]
    assert got == ["Previous Answer: yes\n\nPrevious Charts: Chart 1: 2 columns, 1 rows", "Previous Answer: plain"]


def test_catalogue_errors_and_samples(spark, tmp_path):
    spark.createDataFrame([(i % 30, f"v{i % 12:02d}", i / 2) for i in range(300)], "a int, b string, c double").write.parquet(str(tmp_path / "t.parquet"))
    got = {(r["file_name"], r["column"]): r for r in catalogue.catalogue_rows(
        spark, {str(tmp_path / "t.parquet"): "parquet", str(tmp_path / "gone.parquet"): "parquet"}).collect()}
    assert got["t.parquet", "a"]["sample_values"] == ["0", "1", "2", "3", "4"] and got["t.parquet", "a"]["data_type"] == "int"
    assert got["t.parquet", "b"]["sample_values"] == [f"v{i:02d}" for i in range(10)]
    assert got["t.parquet", "c"]["data_type"] == "float"
    assert "gone.parquet" in got["gone.parquet", None]["error"]


def test_catalogue_reports_a_dataset_with_a_broken_file(spark, tmp_path):
    good, bad, empty, torn = (str(tmp_path / n) for n in ("good.parquet", "bad.parquet", "empty.parquet", "torn.parquet"))
    spark.range(5).write.parquet(good)
    spark.range(5).coalesce(1).write.parquet(bad)
    spark.range(0).write.parquet(empty)
    (tmp_path / "torn.parquet").write_bytes(b"no footer at all, whatever the name says")
    (tmp_path / "bad.parquet" / "zz.parquet").write_bytes(b"PAR1 this is not a parquet file PAR1")
    got = {r["file_name"]: r for r in catalogue.catalogue_rows(spark, dict.fromkeys((good, bad, empty, torn), "parquet")).collect()}
    assert got["bad.parquet"]["error"] and got["bad.parquet"]["column"] is None
    assert got["torn.parquet"]["error"] and "An error occurred" not in got["torn.parquet"]["error"]
    assert got["good.parquet"]["error"] is None and got["good.parquet"]["sample_values"] == ["0", "1", "2", "3", "4"]
    assert got["empty.parquet"]["error"] is None and got["empty.parquet"]["column"] is None


def test_profile_per_file(spark, tmp_path):
    base = str(tmp_path / "d")
    spark.range(5).write.parquet(base)
    spark.range(100, 103).write.mode("append").parquet(base)
    got = catalogue.profile_columns(spark.read.parquet(base), F.col("_metadata.file_name")).collect()
    # NaN in an early batch must not hide later numbers.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        numbers = [float("nan")] + [100.0 + i for i in range(9)] + [1.0, 2.0, 3.0]
        (nan,) = catalogue.profile_columns(spark.createDataFrame([(x,) for x in numbers], "v double").coalesce(1)).collect()
        assert nan["sample_values"] == ["1.0", "2.0", "3.0", "100.0", "101.0"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted(v for r in got for v in r["sample_values"]) == sorted(["0", "1", "2", "3", "4", "100", "101", "102"])
    assert len(got) > 1


def test_transforms(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0)], "k string, c string, v double")
    assert rows(transforms.crosstab(d, "k", "c", ["x", "y"], "v")) == [("a", 1.0, 2.0), ("b", 4.0, 0.0)]
    assert sorted(r["scaled"] for r in transforms.min_max(d, "v").collect()) == pytest.approx([0, 1 / 3, 1])
    z = [r["z"] for r in transforms.z_score(d, "v", ["k"]).collect()]
    assert sorted(x for x in z if x is not None) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)]) and z.count(None) == 1
    s = spark.createDataFrame([("a", i, 2.0 * i + 1) for i in range(5)], "g string, s int, v double")
    assert [r["forecast"] for r in transforms.linear_forecast(s, "g", "s", "v", 2).orderBy("s").collect()] == pytest.approx([11, 13])


def test_register_flow(spark):
    r = spark.createDataFrame([("ACME", "1", "acme"), ("BETA", "2", "beta")], "CompanyName string, CompanyNumber string, CompanyName_lower string")
    j = register.prepare_judgements(register.latest_judgements(register.combine(
        register.clean_judgements(spark.createDataFrame([("R2", "00Acme ", "G1", "2024-01-01")], "`Reg Code` string, `Provider name` string, Gov string, `Publication Date` string")),
        register.clean_judgements(spark.createDataFrame([("R1", "acme", "G2", "2023-01-01"), ("R0", "beta", "G1*", "2023-01-01")], "`Reg Code` string, `Provider` string, Gov string, `Publication Date` string")))))
    clients = register.client_map(spark.createDataFrame([("n", "007", "0001")], "name string, CpartyId string, MapId string"),
                                  spark.createDataFrame([("7 ", "C7")], "CpartyId string, MapId string"))
    f = spark.createDataFrame([("7", "f1", 1.0), ("7", "f2", 2.0)], "counterparty_id string, facility_id string, drawn_balance double")
    got = rows(register.assemble(r, j, clients, f).select("CompanyName", "Reg Code", "IsRegistered", "ClientFlag", "facility_id"))
    assert got == [("ACME", "R2", True, True, "f1"), ("ACME", "R2", True, True, "f2"), ("BETA", None, False, False, None)]

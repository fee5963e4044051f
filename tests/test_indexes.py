"""Written indexes: keyword postings and vector cells."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from crosstally.operators import text_index, vector_cells
from crosstally.sources.sinks import scratch

WORDS = [f"word{i}" for i in range(40)]


def corpus(rng, n=400):
    weights = [1 / (1 + i) for i in range(len(WORDS))]
    docs = [(i * 3 - 50, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 30)))) for i in range(n)]
    return docs + [(9000, None), (9001, "!!"), (9002, "Word1 WORD1 word1"), (-7001, "word39 word38")]


def bm25(docs, text, k):
    bags = {i: re.findall(r"\w{2,}", (t or "").lower()) for i, t in docs}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = Counter(t for b in bags.values() for t in set(b))
    scores = {}
    for i, b in bags.items():
        tf = Counter(b)
        for t in set(re.findall(r"\w{2,}", (text or "").lower())):
            if tf[t]:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                scores[i] = scores.get(i, 0) + idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(b) / mean))
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.fixture(scope="module")
def written(spark):
    rng = random.Random(4)
    docs, path = corpus(rng), scratch(spark, "test-index")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(text_index, "BLOCK", 16)
        text_index.write_index(spark.createDataFrame(docs + [(None, "word1 lost")], "doc_id long, text string").repartition(4), "doc_id", "text", path, 8)
        yield docs, path


def test_search_equals_bm25(spark, written):
    docs, path = written
    rng = random.Random(6)
    asked = [(f"q{i}", " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))) for i in range(25)] + [("none", None), ("unknown", "nowhere"), ("twice", "word1"), ("twice", "word2 word1")]
    got = {}
    for r in text_index.search(spark, path, spark.createDataFrame(asked, "query string, text string"), 7).collect():
        got.setdefault(r.query, []).append((r.position, r.doc_id, round(r.score, 6)))
    for name, text in asked[:-2] + [("twice", "word1 word2")]:
        assert sorted(got.get(name, [])) == [(p + 1, i, round(s, 6)) for p, (i, s) in enumerate(bm25(docs, text, 7))], name


def test_few_blocks_are_opened(spark, written):
    """A request for a rare and a common word does not open the blocks that hold the common one only."""
    _, path = written
    wanted, postings, mean = text_index.asked_terms(spark, path, spark.createDataFrame([("q", "word0 word38")], "query string, text string"), "query", "text")
    blocks = postings.join(wanted, ["bucket", "term"]).select("block").distinct().count()
    before = set(scratches(spark))
    text_index.search(spark, path, spark.createDataFrame([("q", "word0 word38")], "query string, text string"), 2).collect()
    opened = [p for p in set(scratches(spark)) - before if "open-blocks" in p]
    assert len(opened) == 1 and spark.read.parquet(opened[0]).count() < blocks / 2


def scratches(spark):
    import os
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return [f"{base}/{n}" for n in os.listdir(base)]


def test_requests_read_their_buckets_only(spark, written):
    _, path = written
    _, postings, _ = text_index.asked_terms(spark, path, spark.createDataFrame([("q", "word3")], "query string, text string"), "query", "text")
    plan = postings._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert postings.select("bucket").distinct().count() == 1


def test_index_of_nothing(spark):
    path = scratch(spark, "test-index")
    text_index.write_index(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), "doc_id", "text", path, 4)
    assert spark.read.parquet(f"{path}/corpus").first().n == 2
    assert text_index.search(spark, path, spark.createDataFrame([("q", "word1")], "query string, text string")).count() == 0
    with pytest.raises(Exception):
        text_index.write_index(spark.createDataFrame([(1, "a1")], "doc_id long, text string"), "doc_id", "text", path, 4)


def vectors(rng, n=600, dim=8):
    centres = rng.normal(size=(6, dim)) * 4
    rows = [(i, (centres[i % 6] + rng.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 3)]  # one vector on a quarter of the rows
    return rows + [(5000, None), (5001, [0.0] * dim), (5002, [float("nan")] * dim), (5003, [None] * dim), (5004, [2.0 * x for x in rows[0][1]]), (None, rows[1][1])]


def cosine_hits(rows, probe, k):
    v = {i: np.array(x, float) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(x)}
    p = np.array(probe)
    scores = {i: float(x @ p / np.sqrt((x @ x) * (p @ p))) for i, x in v.items()}
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.mark.parametrize("cells,piece", [(12, 50), (1, 4096), (40, 7)])
def test_cells_equal_full_scan(spark, cells, piece):
    rng = np.random.default_rng(cells)
    rows, path = vectors(rng), scratch(spark, "test-cells")
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    vector_cells.write_cells(df, "id", "v", path, cells, piece)
    asked = [(f"q{i}", rows[i * 7][1]) for i in range(20)] + [("none", None), ("zero", [0.0] * 8), ("far", rng.normal(size=8).tolist())]
    got = {}
    for r in vector_cells.search(spark, path, spark.createDataFrame(asked, "query string, vector array<double>"), 9, key="id").collect():
        got.setdefault(r.query, []).append((r.position, r.id, round(r.score, 7)))
    assert not {"none", "zero"} & set(got)
    for name, probe in asked:
        if name in got:
            want = cosine_hits(rows, probe, 9)
            assert [(p, i) for p, i, _ in sorted(got[name])] == [(p + 1, i) for p, (i, _) in enumerate(want)], name
            assert [s for *_, s in sorted(got[name])] == pytest.approx([s for _, s in want], abs=1e-6)
    assert len(got) == 21


def test_cells_are_skipped(spark):
    rng = np.random.default_rng(5)
    rows, path = vectors(rng), scratch(spark, "test-cells")
    vector_cells.write_cells(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", path, 12, 4096)
    before = set(scratches(spark))
    asked = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in range(6)], "query string, vector array<double>")
    vector_cells.search(spark, path, asked, 5, key="id").collect()
    opened = [p for p in set(scratches(spark)) - before if "open-cells" in p]
    assert len(opened) == 1 and spark.read.parquet(opened[0]).count() < 6 * spark.read.parquet(f"{path}/cells").count() / 2


def test_cells_of_nothing(spark):
    path = scratch(spark, "test-cells")
    vector_cells.write_cells(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v", path, 4)
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "query string, vector array<double>")
    assert vector_cells.search(spark, path, asked, 5, key="id").count() == 0


def test_scores_stay_with_their_block(spark, written, monkeypatch):
    """Of a block at most the documents near the best k leave, ties by document; requests come in parts."""
    docs, path = written
    monkeypatch.setattr(text_index, "REQUESTS", 2)
    asked = [(f"q{i}", f"word{i} word{i + 1} word0") for i in range(7)] + [(None, "word1")]
    got = {}
    for r in text_index.search(spark, path, spark.createDataFrame(asked, "query string, text string"), 3).collect():
        got.setdefault(r["query"], []).append((r.position, r.doc_id, round(r.score, 9)))
    for name, t in asked[:-1]:
        assert [x[1:] for x in sorted(got[name])] == [(i, round(v, 9)) for i, v in bm25(docs, t, 3)]
    assert None not in got
    assert text_index._best(np.array([1.0, 3, 1, 1, 3 - 1e-12, 1]), 3).tolist() == [1, 4, 0, 2, 3]

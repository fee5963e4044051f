import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from crosstally.llm import topk


def brute(rows, k, query):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if query(i):
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, a in asked.items():
        found = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q and len(v) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, v int, terms string")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 3 == 0, k=k).collect()))


@pytest.mark.parametrize("shard,block,queries", [(16384, 2048, 1024), (40, 16, 7)])
def test_against_brute_force(spark, monkeypatch, shard, block, queries):
    for name, n in (("SHARD", shard), ("BLOCK", block), ("FIRST", 8), ("QUERIES", queries), ("TOGETHER", 5)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=10).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    rows += [(300, None), (303, [1.0] * 9 + [None]), (306, [math.nan] * 10), (309, [math.inf] * 10), (None, [1.0] * 10), (312, [0.0] * 10),
             (3, rows[3][1]), (9, [5.0] * 10), (315, [1.0, 2.0]), (316, [2.0, 1.0]), (318, []), (319, [1e6] * 10), (400, rows[3][1]), (400, rows[3][1])]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e7 + i / 64, -(1e7 + i)]) for i in range(40)] + [(i, [3e7 + i / 64, 2e7]) for i in range(40, 60)]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_scores_beyond_a_long_and_close_ones(spark):
    """Ranked by value, reported as the nearest long; scores beyond 2^53 that differ by one are told apart."""
    rows = [(i, [3e9 + i, 3e9 - i]) for i in range(12)] + [(20 + i, [1e16 + 4096 * i, 1.0]) for i in range(9)]
    rows += [(40 + i, [2.0 ** 27 + i % 7 / 64, i / 64]) for i in range(30)]
    within = lambda x: min(max(x, -1 << 63), (1 << 63) - 1)
    assert run(spark, rows) == [(*r[:3], within(r[3])) for r in brute(rows, 5, lambda i: i % 3 == 0)]


def test_one_id_on_most_rows(spark, monkeypatch):
    for name, n in (("SHARD", 30), ("QUERIES", 4), ("ALIKE", 3)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(6)
    rows = [(5, rng.normal(size=4).round(2).tolist()) for _ in range(150)] + [(i, rng.normal(size=4).round(2).tolist()) for i in range(40)]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_postings_that_no_query_needs_are_left_out():
    weights, block = np.array([[0, 3, 0], [0, 0, 0], [2, 1, 0]]), np.arange(12).reshape(4, 3)
    got = topk._traversed(weights, np.array([1, 0, 2]), block)
    assert (got == weights @ block.T).all()


def test_few_and_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(3, [1.0])]) == [] and run(spark, [(3, [1.0]), (4, [2.0])]) == [(3, 1, 4, 64 * 128)]


def test_most_pairs_are_never_completed():
    """MaxScore leaves out work: a skewed collection needs few of all probes."""
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(6000, 32)) * np.geomspace(60, 0.5, 32)).astype(np.int64)
    shard = topk.Shard(np.arange(6000), vectors)
    ids, found, score = topk.search(np.array([-1]), vectors[:1], shard, 10)
    want = sorted(((-int(vectors[0] @ v), i) for i, v in enumerate(vectors)))[:10]
    assert list(zip((-score).tolist(), found.tolist())) == want
    order, rest = topk.bounds(vectors[:1].astype(float), shard)
    assert (rest[0] <= score[-1]).argmax() < 16

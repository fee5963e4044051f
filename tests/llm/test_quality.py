import math
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from crosstally.llm import quality
from crosstally.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_views():
    assert quality.token_buckets("Word") != quality.token_buckets("WORD") and quality.token_buckets("Word")[0] == quality.token_buckets("word%%%")[0]
    for odd in ("", "%%%", "_", "á!", "--a--b--"):
        assert len(quality.token_buckets(odd)) == 2
    assert len(quality.layout(None, None, None, None)) == len(quality.layout("A\nb1 .", "s", "en", 6.0)) == len(quality.layout("", "", "", float("nan")))


def test_logistic_finds_the_odds():
    x = np.array([[0.0]] * 100 + [[1.0]] * 100)
    y = np.array([1] * 20 + [0] * 80 + [1] * 90 + [0] * 10)
    slope, bias = quality.logistic(x, y)
    p = 1 / (1 + np.exp(-np.array([bias, slope + bias])))
    assert np.allclose(p, [0.2, 0.9], atol=0.03)
    assert quality.logistic(x, np.ones(200))[-1] > 2


def test_pseudo_labels_of_one_view_teach_the_other():
    """The metadata view cannot tell documents of an unseen source; the text view's labels teach it."""
    rng = np.random.default_rng(0)
    good = np.arange(600) % 2
    text = [[1, int(rng.integers(20, 60))] if g else [2, int(rng.integers(20, 60))] for g in good]
    meta = [[100 + g] if i < 40 else [200 + g] for i, g in enumerate(good)]
    label = np.where(np.arange(600) < 40, good, -1)
    bags = [quality.Bags(v, [np.ones(len(d)) for d in v]) for v in (text, meta)]
    calibrates = np.arange(600) % 4 == 3
    alone, taught = (quality.fit(*bags, label, calibrates, rounds=r).meta for r in (0, 3))
    assert abs(alone[201] - alone[200]) < 0.01 < 1 < taught[201] - taught[200]


def test_null_and_repeated_rows(spark, docs):
    rows = [(i, ("Fine words of a text. " * 5 if i % 3 else "bad%%% words&&& " * 5), "en", f"s{i % 4}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120)] + [(None, 1), (150, None), (7, 1), (7, 1), (9999, 0)], "doc_id long, quality int")
    frame = docs(rows + [(500, None), (501, ""), (None, "Fine words of a text."), (7, "Fine words of a text. " * 5, "en", "s3"), (502, "x " * 300000)])
    model = quality.train(frame, labels)
    got = quality.predict(frame, model).collect()
    assert len(got) == 205 and all(0 <= r.score <= 1 for r in got) and set(frame.columns) < set(got[0].__fields__)
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert quality.predict(docs([]), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(999, 0), (998, 1)]])
def test_without_labels_of_both_kinds(spark, docs, labels):
    frame = docs([(1, "a"), (2, "b")])
    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r.score for r in quality.predict(frame, model).collect()] == [0.5, 0.5]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, kept = got.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("double")))).first()
    assert right > 0.9 and kept > 0.95


class PlainView:
    """Naive Bayes over dictionaries of feature counts."""

    def __init__(self, bags):
        self.bags = bags

    def weights(self, labels):
        """Log of each feature's share in good documents over that in bad ones, from {document: label}."""
        shares = []
        for kind in (1, 0):
            total = {b: 0.01 for b in range(quality.BUCKETS + 1)}
            for i, label in labels.items():
                if label == kind:
                    size = max(sum(self.bags[i].values()), 1)
                    for b, n in self.bags[i].items():
                        total[b] += n / size
            whole = sum(total.values())
            shares.append({b: v / whole for b, v in total.items()})
        return {b: math.log(shares[0][b] / shares[1][b]) for b in shares[0]}

    def margin(self, i, weights):
        return sum(n * weights[b] for b, n in self.bags[i].items()) / max(sum(self.bags[i].values()), 1)


def plain_logistic(rows, labels):
    """Weights and intercept by Newton's method on the smoothed targets with the weak ridge."""
    n1, n0 = sum(labels), len(labels) - sum(labels)
    x = [[*r, 1.0] for r in rows]
    t = [(n1 + 1) / (n1 + 2) if y else 1 / (n0 + 2) for y in labels]
    size = len(x[0])
    ridge = [1e-3] * (size - 1) + [1e-9]
    w = [0.0] * (size - 1) + [math.log((n1 + 1) / (n0 + 1))]
    for _ in range(200):
        p = [1 / (1 + math.exp(-max(-35, min(35, sum(a * b for a, b in zip(r, w)))))) for r in x]
        gradient = [sum((pi - ti) * r[k] for pi, ti, r in zip(p, t, x)) + ridge[k] * w[k] for k in range(size)]
        hessian = [[sum((pi * (1 - pi) + 1e-9) * r[a] * r[b] for pi, r in zip(p, x)) + (ridge[a] if a == b else 0) for b in range(size)] for a in range(size)]
        w = [a - b / 2 for a, b in zip(w, np.linalg.solve(hessian, gradient))]
    return w


def plain_scores(documents, label, calibrates, rounds=5, each_round=60):
    """Co-training in plain Python: {key: (text score, metadata score, score)} from (key, text, source, lang, n_chars)."""
    text, meta = {}, {}
    for key, body, *more in documents:
        tokens = (body or "").split()
        text[key] = Counter(b for t in tokens for b in quality.token_buckets(t))
        again = sum(a == b for a, b in zip(tokens, tokens[1:]))
        text[key].update({quality.REPEAT: again} if again else {})
        meta[key] = Counter(quality.layout(body, *more))
    views = (PlainView(text), PlainView(meta))
    known = {k: y for k, y in label.items() if not calibrates(k)}
    taught, free = [dict(known), dict(known)], sorted(k for k in text if k not in label)
    share = sum(known.values()) / len(known)
    for _ in range(rounds):
        weights = [v.weights(t) for v, t in zip(views, taught)]
        taken = set()
        for mine, other in ((0, 1), (1, 0)):
            order = sorted(free, key=lambda k: views[mine].margin(k, weights[mine]))
            size = min(each_round, len(order))
            n1 = round(size * share)
            for chosen, y in ((order[:size - n1], 0), (order[len(order) - n1:], 1)):
                taught[other].update(dict.fromkeys(chosen, y))
                taken.update(chosen)
        free = [k for k in free if k not in taken]
    weights = [v.weights(t) for v, t in zip(views, taught)]
    held = [k for k in sorted(label) if calibrates(k)]
    y = [label[k] for k in held]
    lines = [plain_logistic([[v.margin(k, w)] for k in held], y) for v, w in zip(views, weights)]
    odds = {k: [c[0] * v.margin(k, w) + c[1] for v, w, c in zip(views, weights, lines)] for k in text}
    mix = plain_logistic([odds[k] for k in held], y)
    p = lambda z: 1 / (1 + math.exp(-max(-35, min(35, z))))
    return {k: (p(t), p(m), p(mix[0] * t + mix[1] * m + mix[2])) for k, (t, m) in odds.items()}


def test_query_against_plain_co_training(spark):
    """The smallest table is within the sample sizes, so all of it is the sample."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told, usable = set(label), {k: y for k, y in label.items() if zlib.crc32(str(k).encode()) % 3 != 1}
    sample = [(d.doc_id, d.text, d.source, d.lang, d.n_chars) for d in docs]
    # Held-out labels teach nothing, and their documents are not in the pool of unlabelled ones either.
    taught = [r for r in sample if r[0] in usable or r[0] not in told]
    got = {r.doc_id: (r.text_score, r.meta_score, r.score) for r in QUERIES["op8_quality_classifier"](spark, SF).collect()}
    want = plain_scores(taught, {k: y for k, y in usable.items() if k in {r[0] for r in taught}}, lambda k: zlib.crc32(str(k).encode()) % 4 == 3)
    for key, scores in want.items():
        assert got[key] == pytest.approx(scores, abs=1e-3), key
    assert len(want) > 150

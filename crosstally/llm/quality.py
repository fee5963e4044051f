"""Quality classifier by co-training of two views of a document.

The text view sees the words: each token's letters, what stands around them, and tokens that repeat the one before. The metadata view sees where
the page is from (source, language, declared length) and its layout (lines and the shares of capitals, digits,
marks, white space). Both are naive Bayes classifiers over hashed features. They start from a labelled sample;
in each round either one labels the unlabelled documents it is most sure of, in the proportion of the
classes, and these become training documents of the other. Each view is then calibrated on labelled documents
that trained neither, and a logistic model of the two calibrated views gives the score.

Fitting takes bounded, documented samples (``labelled`` and ``pool`` documents, the smallest hashes of their
keys); only their feature counts reach the driver. Scoring runs over all whole texts with two weight tables of
fixed size as broadcast, without a shuffle.
"""

from __future__ import annotations

import re
from itertools import islice
from operator import eq
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import materialise
from .samples import keys_by_hash, rows_of

BUCKETS = 1 << 14
REMEMBERED = 200_000
TOKEN = re.compile(r"(\W*)(.*?)(\W*)", re.DOTALL)
# A bucket of its own for repeated tokens.
REPEAT = BUCKETS
META = ("source", "lang", "n_chars")


class Model(NamedTuple):
    text: np.ndarray       # weight of each bucket
    meta: np.ndarray
    calibration: tuple     # (slope, intercept) of the text view, of the metadata view
    combination: tuple     # weights of the two calibrated log-odds, intercept


def token_buckets(token: str) -> tuple[int, int]:
    """Buckets of a token's letters, lower-cased, and of what is around them with the way it is written."""
    before, body, after = TOKEN.fullmatch(token).groups()
    case = "u" if body.isupper() and len(body) > 1 else "c" if body[:1].isupper() else "l"
    return crc32(body.lower().encode("utf-8", "replace")) % BUCKETS, crc32(f"{before}|{case}|{after}".encode("utf-8", "replace")) % BUCKETS


def repeats(tokens: list[str]) -> int:
    """Tokens that repeat the one before."""
    return sum(map(eq, tokens, islice(tokens, 1, None)))


def layout(text: str | None, source, lang, n_chars) -> list[int]:
    """Buckets of the metadata view, one for each property."""
    data = np.bincount(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(int(data.sum()), 1)
    share = lambda what: int(20 * data[what].sum() / n)
    lines, size = int(data[10]), int(data.sum())
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    found = {"source": source, "lang": lang, "declared": None if n_chars is None or pd.isna(n_chars) else int(n_chars).bit_length(), "size": size.bit_length(),
             "lines": lines.bit_length(), "line": (size // (lines + 1)).bit_length(), "capitals": share(slice(65, 91)), "digits": share(slice(48, 58)),
             "marks": share(marks), "white": share([9, 10, 13, 32])}
    return [crc32(f"{k}={v}".encode("utf-8", "replace")) % BUCKETS for k, v in found.items()]


class Bags:
    """Documents as bags of buckets."""

    def __init__(self, indices: list, counts: list):
        self.row = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
        self.index = np.concatenate([np.asarray(i, np.int32) for i in indices]) if indices else np.zeros(0, np.int32)
        self.count = np.concatenate([np.asarray(c, np.float32) for c in counts]) if counts else np.zeros(0, np.float32)
        self.size = np.maximum(np.bincount(self.row, self.count, len(indices)), 1)

    def weights(self, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Naive Bayes: log of a bucket's share in good documents over that in bad ones; a document counts one,
        whatever its length."""
        label = np.full(len(self.size), -1)
        label[rows] = labels
        part = self.count / self.size[self.row]
        good, bad = (np.bincount(self.index, part * (label[self.row] == k), BUCKETS + 1) + 0.01 for k in (1, 0))
        return np.log(good / good.sum()) - np.log(bad / bad.sum())

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.count * weights[self.index], len(self.size)) / self.size


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a small logistic model: Newton steps with a weak ridge, targets drawn in from 0 and 1."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1e-3] * x.shape[1] + [1e-9])
    w = np.append(np.zeros(x.shape[1]), np.log((n1 + 1) / (n0 + 1)))

    def loss(v):
        z = a @ v
        return np.logaddexp(0, z).sum() - target @ z + v @ ridge @ v / 2

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        gradient = a.T @ (p - target) + ridge @ w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, gradient)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(text: Bags, meta: Bags, label: np.ndarray, calibrates: np.ndarray, rounds: int = 5, each_round: int = 60) -> Model | None:
    """Co-train on documents with ``label`` 1, 0 or -1 (unknown); labelled ones in ``calibrates`` train no view.
    None without a label of either kind."""
    known = np.flatnonzero((label >= 0) & ~calibrates)
    if len(set(label[known])) < 2:
        return None
    views = (text, meta)
    rows = [known, known]
    labels = [label[known], label[known]]
    free = label < 0
    good = label[known].mean()
    for _ in range(rounds):
        margins = [v.margins(v.weights(r, y)) for v, r, y in zip(views, rows, labels)]
        taken = np.zeros(len(label), bool)
        for mine, other in ((0, 1), (1, 0)):
            order = np.flatnonzero(free)[np.argsort(margins[mine][free], kind="stable")]
            size = min(each_round, len(order))
            n1 = round(size * good)
            n0 = size - n1
            chosen = np.concatenate([order[:n0], order[len(order) - n1:]])
            rows[other] = np.concatenate([rows[other], chosen])
            labels[other] = np.concatenate([labels[other], np.repeat([0, 1], [n0, n1])])
            taken[chosen] = True
        free &= ~taken
    weights = [v.weights(r, y) for v, r, y in zip(views, rows, labels)]
    held = np.flatnonzero((label >= 0) & calibrates)
    held = held if len(set(label[held])) == 2 else known
    y = label[held]
    margins = [v.margins(w)[held] for v, w in zip(views, weights)]
    calibration = [logistic(m[:, None], y) for m in margins]
    odds = np.column_stack([c[0] * m + c[1] for c, m in zip(calibration, margins)])
    return Model(*weights, tuple(map(tuple, calibration)), tuple(logistic(odds, y)))


def features(docs: DataFrame, text: str) -> DataFrame:
    """``key, label, text_index, text_count, meta_index`` of sampled documents (``key, label``, text and metadata)."""
    def run(batches):
        for frame in batches:
            out = []
            for key, label, body, *meta in frame.itertuples(index=False, name=None):
                tokens = (body or "").split()
                buckets = np.array([b for t in tokens for b in token_buckets(t)] + [REPEAT] * repeats(tokens), np.int64)
                index, count = np.unique(buckets, return_counts=True)
                out.append((key, label, index, count.astype(np.float32), layout(body, *meta)))
            yield pd.DataFrame(out, columns=["key", "label", "text_index", "text_count", "meta_index"])

    return docs.select("key", "label", text, *META).mapInPandas(
        run, "key bigint, label int, text_index array<int>, text_count array<float>, meta_index array<int>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", usable: Column | None = None,
          labelled: int = 2000, pool: int = 2000) -> Model | None:
    """Fit on at most ``labelled`` labelled and ``pool`` unlabelled documents. ``docs`` has the columns of
    documents; ``usable`` (of the key) keeps labels out of the training. Of contradicting labels the majority
    counts (half: good); null keys and labels teach nothing."""
    k = F.col(f"`{key}`").cast("bigint").alias("key")
    told = labels.select(k, F.col(f"`{label}`").alias("l")).dropna().groupBy("key").agg((F.avg("l") >= 0.5).cast("int").alias("label"))
    known = rows_of(told, keys_by_hash(told.filter(usable if usable is not None else F.lit(True)), labelled), "key")
    free = keys_by_hash(docs.select(k).join(told.select("key"), "key", "left_anti"), pool).select("key", F.lit(-1).alias("label"))
    body = docs.select(k, F.col(f"`{text}`").cast("string").alias(text), *[F.col(f"`{c}`") for c in META])
    rows = rows_of(body, materialise(known.unionByName(free), "quality-sample"), "key")
    # Of repeated keys one row teaches, so that no key can grow the sample.
    rows = rows.groupBy("key", "label").agg(F.min(F.struct(text, *META)).alias("s")).select("key", "label", "s.*")
    got = features(rows, text).toPandas().sort_values(["key", "label"], kind="stable")
    if not len(got):
        return None
    ones = [np.ones(len(i), np.float32) for i in got.meta_index]
    calibrates = np.array([crc32(str(i).encode()) % 4 == 3 for i in got.key])
    return fit(Bags(got.text_index.tolist(), got.text_count.tolist()), Bags(got.meta_index.tolist(), ones), got.label.to_numpy(), calibrates)


class Scorer:
    """Scores texts with a model; remembers the weights of tokens met before, up to a fixed number."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _weigh(self, token: str) -> float:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        a, b = token_buckets(token)
        w = self.known[token] = float(self.model.text[a] + self.model.text[b])
        return w

    def text_margin(self, text: str | None) -> float:
        tokens = (text or "").split()
        found = list(map(self.known.get, tokens))
        if None in found:
            found = [self._weigh(t) if w is None else w for t, w in zip(tokens, found)]
        again = repeats(tokens)
        return (sum(found) + again * float(self.model.text[REPEAT])) / max(2 * len(found) + again, 1)

    def meta_margin(self, *properties) -> float:
        buckets = layout(*properties)
        return float(self.model.meta[buckets].sum()) / len(buckets)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``text_score, meta_score, score`` (0 to 1: how likely the document is good) to every row.

    Null and empty texts have no words, so only their metadata speaks; null metadata is a value of its own.
    Without a model (no labels of one kind) all scores are 0.5. Repeated rows get the same scores.
    """
    names = ("text_score", "meta_score", "score")
    if model is None:
        return docs.withColumns({n: F.lit(0.5) for n in names})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    probability = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    @F.pandas_udf("text_score double, meta_score double, score double")
    def rate(body: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        scorer, (ct, cm), mix = Scorer(shared.value), shared.value.calibration, shared.value.combination
        margins = np.array([(scorer.text_margin(b), scorer.meta_margin(b, *m)) for b, *m in zip(body, source, lang, n_chars)]).reshape(-1, 2)
        t, m = ct[0] * margins[:, 0] + ct[1], cm[0] * margins[:, 1] + cm[1]
        return pd.DataFrame({"text_score": probability(t), "meta_score": probability(m), "score": probability(mix[0] * t + mix[1] * m + mix[2])})

    out = docs.withColumn("__rate", rate(F.col(f"`{text}`").cast("string"), *[F.col(f"`{c}`") for c in META]))
    return out.withColumns({n: F.col(f"__rate.{n}") for n in names}).drop("__rate")

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import pyspark.sql.functions as F

from crosstally.llm import lm
from crosstally.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [" "]


def rounded(c):
    """The count as the filter gives it back."""
    return lm.ROUNDED[1 + math.floor(math.log(c) / math.log(lm.BASE) + 1e-9)] if c else 0.0


def brute(train, texts, prior):
    """n_tokens, n_known, base and model score of texts by exact dictionaries of rounded counts."""
    one, two = Counter(), Counter()
    for text in train:
        t = tokens_of(text)
        one.update(t)
        two.update(zip([" ", *t], t))
    n, v = sum(one.values()), len(one)
    out = []
    for text in texts:
        t, s = tokens_of(text), 0.0
        for before, w in zip([" ", *t], t):
            p = (rounded(one[w]) + 0.1) / (n + 0.1 * (v + 1))
            s += math.log10((min(rounded(two[before, w]), rounded(one[w])) + prior * p) / (rounded(one[before]) + prior))
        out.append((len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), s))
    return out


def some_texts(rng, n):
    common = ["the", "The", "of", "É", "und", "a"]
    return [" ".join(rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 80))) for _ in range(n)] + ["", None, " \t", "X"]


@pytest.mark.parametrize("most_heavy,most_bytes,tokens_per_part", [(1 << 17, 160 << 20, 1 << 20), (3, 160 << 20, 100), (0, 1, 1000), (20, 4000, 50)])
def test_equals_dictionaries(spark, docs, monkeypatch, most_heavy, most_bytes, tokens_per_part):
    """With so many bits that false positives do not come up; many parts, cut tokens, groups of parts, few heavy tokens."""
    monkeypatch.setattr(lm, "OCCURRENCES", 40)
    rng = random.Random(3)
    train, texts = some_texts(rng, 120), some_texts(rng, 20)
    model = lm.train(docs([(i, t) for i, t in enumerate(train)]), prior=5.0, most_heavy=most_heavy, most_bytes=most_bytes, bits_per_entry=400, tokens_per_part=tokens_per_part)
    assert model.keys.parts == 1 + model.tokens // tokens_per_part and len(model.keys.heavy) <= max(most_heavy, 0)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs([(i, t) for i, t in enumerate(texts)]), model).collect())
    for (_, *g), w in zip(got, brute(train, texts, 5.0)):
        assert tuple(g[:3]) == w[:3]
        assert g[3:] == pytest.approx(w[3:], rel=1e-9, abs=1e-9)


def test_rounded_counts():
    for c in [*range(1, 200), 10**6, 10**12]:
        assert abs(math.log(rounded(c) / c)) < math.log(lm.BASE)
    assert rounded(1) == 1 and rounded(2) == 2


def test_filter_gives_counts_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 30_000, dtype=np.uint64))
    counts = rng.integers(1, 5000, len(keys))
    words = lm.filter_of(keys, counts)
    group = lm.Filter(4, np.array([0, len(words), len(words)]), words)
    told = group.counts(np.full(len(keys), 4), keys)
    right = np.array([rounded(c) for c in counts.tolist()])
    assert (told >= right).all() and (told == right).mean() > 0.95
    absent = rng.integers(0, 1 << 48, 30_000, dtype=np.uint64)
    assert (group.counts(np.full(len(absent), 4), absent) > 0).mean() < 0.04
    assert (group.counts(np.full(len(absent), 5), absent) == 0).all()
    assert lm.filter_of(keys[:0], counts[:0]).tolist() == [0]


def test_blocks_of_often_met_pairs():
    keys = np.array([3, 1 << 47, (1 << 48) - 1], np.uint64)
    assert lm.from_six_bytes(lm.six_bytes(keys)).tolist() == keys.tolist()


def test_pairs_over_255(spark, docs):
    texts = ["a b " * 1000, "a b " * 30]
    model = lm.train(docs([(i, t) for i, t in enumerate(texts)]), bits_per_entry=400, prior=2.0)
    got = lm.score(docs([(1, "a b")]), model).collect()[0]
    assert got.score == pytest.approx(brute(texts, ["a b"], 2.0)[0][4])


def test_nulls_repeats_ties_and_no_rows(spark, docs):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (2, "")]
    model = lm.train(docs(rows))
    got = lm.score(docs(rows), model).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == Counter({(1, 4, 4, 14): 2, (None, 4, 4, 14): 1, (2, 1, 1, 14): 2})
    assert len({r.score for r in got if r.n_tokens == 4}) == 1
    assert lm.score(docs([]), model).count() == 0
    nothing = lm.train(docs([]))
    assert (nothing.tokens, nothing.distinct) == (0, 0)
    got = lm.score(docs([(1, "x y")]), nothing).collect()[0]
    assert (got.n_tokens, got.n_known, got.base_score, got.score) == (3, 0, 0.0, 0.0)


def test_very_long_text_and_word(spark, docs):
    texts = [" ".join(f"w{i % 999}" for i in range(300_000)), "y" * 1_000_000 + " z"]
    model = lm.train(docs([(i, t) for i, t in enumerate(texts)]))
    got = sorted((r.doc_id, r.n_tokens, r.n_known) for r in lm.score(docs([(i, t) for i, t in enumerate(texts)]), model).collect())
    assert got == [(0, 300_001, 300_001), (1, 3, 3)]


def test_query(spark):
    import zlib
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op13_lm_scoring"](spark, SF).collect()}
    assert len(got) == len(source) == 200
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in source}
    want = brute([d.text for d in source if not held[d.doc_id]], [d.text for d in source], 256.0)
    for d, w in zip(source, want):
        r = got[d.doc_id]
        assert r.held_out == held[d.doc_id] and (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9)
        # False positives of the filter raise single counts.
        assert r.score == pytest.approx(w[4], rel=0.05, abs=0.5)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)

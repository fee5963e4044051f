import math
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from crosstally.llm import langid


def brute_bits(train, text):
    """PPM by definition: dictionaries of contexts, escapes one byte at a time."""
    trees = {k: defaultdict(Counter) for k in train}
    low = lambda t: b"\0\0\0" + t.encode().lower()
    for lang, texts in train.items():
        for t in texts:
            b = low(t)
            for i in range(3, len(b)):
                for k in range(4):
                    trees[lang][b[i - k:i]][b[i]] += 1
    b, out = low(text), {}
    for lang, tree in trees.items():
        total = 0.0
        for i in range(3, len(b)):
            p, bits = 1.0, None
            for k in (3, 2, 1, 0):
                c = tree.get(b[i - k:i])
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if b[i] in c:
                    bits = p * c[b[i]] / (n + d)
                    break
                p *= d / (n + d)
            total -= math.log2(bits if bits is not None else p / 256)
        out[lang] = total
    return out


TRAIN = {"en": ["the cat and the dog", "another thing that they think"], "fr": ["le chat et été où", "ça va très bien, déjà vu"], "xx": ["ÀÀ", "q"]}


def frame(spark):
    rows = [(i, t, l) for i, (l, t) in enumerate((l, t) for l, ts in TRAIN.items() for t in ts)]
    return spark.createDataFrame([(*r, "en", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_code_lengths_equal_the_definition(spark, monkeypatch):
    model = langid.train(frame(spark))
    texts = ["The cat thinks", "où est le chat", "zzz ÿ", "", None, "日本", "\0a\0", "a" * 50]
    for block in (1 << 20, 7):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = langid.code_lengths(texts, model)
        for row, t in zip(got, texts):
            want = brute_bits(TRAIN, t or "")
            assert np.allclose(row, [want[k] for k in model.languages], rtol=1e-5), t


def test_a_small_table_falls_back_to_shorter_contexts(spark):
    counts = langid.count_contexts(frame(spark))
    full, cut = langid.build(counts), langid.build(counts, most_bytes=0)
    assert len(cut.cost) < len(full.cost)
    bits = langid.code_lengths(["the thing", "le chat"], cut)
    assert bits.argmin(axis=1).tolist() == [0, 1]


def test_predictions_and_undetermined(spark):
    model = langid.train(frame(spark))
    rows = [(1, "the cat thinks that"), (2, None), (3, ""), (4, "123 !? ١"), (5, "le chat très bien"), (None, "the cat"), (5, "le chat très bien"), (6, "été " * 40000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, found int")
    got = langid.predict(docs, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "fr"), (None, "en"), (5, "fr"), (6, "fr")]
    assert all(0 <= r.score <= 1 for r in got) and got[1].score == 0 and got[4].score > 0.9


def test_nothing_to_learn_from(spark):
    empty = frame(spark).filter("false")
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.predict(frame(spark), None).collect()} == {"und"}
    assert langid.predict(empty, langid.train(frame(spark))).count() == 0


def test_held_out_accuracy(spark):
    from crosstally.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_language_id"](spark, sf).join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert got > 0.95


@pytest.mark.parametrize("key,out", [(1, False), (None, False)])
def test_fold(spark, key, out):
    import zlib
    r = spark.createDataFrame([(key,)], "doc_id long").select(langid.held_out().alias("h")).first().h
    assert r == (key is not None and zlib.crc32(str(key).encode()) % 3 == 1)


def test_all_texts_teach_not_a_sample(spark):
    """The one text whose language knows a word, and the one with the highest rate, are among many others."""
    rows = [(i, "the cat and the dog", "en") for i in range(1600)] + [(i, "le chat et la vie", "fr") for i in range(1600, 1605)]
    strange = [(5000 + i, "qxz" * 20, "en") for i in range(2)]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs)
    sampled = langid.train(docs, docs_per_language=5)
    bits, fewer = (langid.code_lengths(["qxzqxz"], m)[0, 0] for m in (model, sampled))
    assert bits < fewer and model.languages == ["en", "fr"]
    alone = spark.createDataFrame(rows + [(5000, "zqwx" * 40, "en")], "doc_id long, text string, lang string")
    assert langid.highest_rates(alone)["en"] > 8 == langid.highest_rates(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"]


def test_counts_of_cut_contexts_stay_in_the_shorter_ones(spark):
    counts = langid.count_contexts(frame(spark))
    table = spark.createDataFrame(counts)
    full = langid.build(counts)
    for room in (langid.MOST_BYTES, full.cost.nbytes * 3 // 4, 1):
        a, b = langid.build(counts, room), langid.build(langid._frequent(table, room), room)
        assert np.allclose(a.cost, b.cost) and (a.context == b.context).all()


def test_of_repeated_keys_the_smallest_text_teaches(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 3)
    once = langid.train(frame(spark))
    more = frame(spark).withColumn("text", F.concat("text", F.lit(" and more")))
    assert np.allclose(langid.train(frame(spark).union(more).union(frame(spark))).cost, once.cost)

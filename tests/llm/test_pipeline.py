import hashlib
import random

import corpus_pipeline
import pyspark.sql.functions as F
import pytest

from .test_decontam import brute as brute_overlap
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def keys(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "quality classifier", "SimHash near-dedup", "benchmark decontamination", "BPE encoding"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = docs.collect()
        if name == "BPE encoding":
            assert sorted(r.doc_id for r in before) == keys(out) and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
            break
        assert out.columns == columns
        path = str(tmp_path / str(n))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept = keys(docs)
        if name == "SimHash near-dedup":
            roots = brute_components([brute_fingerprint(r.text) for r in before])
            assert kept == sorted(min(before[i].doc_id for i in range(len(before)) if roots[i] == r) for r in set(roots))
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept == sorted(r[0] for r in brute_overlap([(r.doc_id, r.text) for r in before], items) if not r[5])
        else:
            assert 0.8 * len(before) < len(kept) <= len(before)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 100 < out.count() < 200


def test_rejected_documents(spark, docs):
    spare = [(i, t, "en", "s") for i, t in enumerate(["123 456", None, "", "the words"])]
    good = [(10 + i, "the words of the text and more", "en", "s") for i in range(10)]
    got = corpus_pipeline.language_id(spark, docs(spare + good).select(*corpus_pipeline.COLUMNS), SF)
    assert keys(got) == [3, *range(10, 20)]


def test_repeated_rows_leave_one(spark, docs):
    rows = [(1, "same text here for all"), (1, "same text here for all"), (2, "same text here for all"), (3, "another text that differs in each word"),
            (None, "same text here for all"), (None, "a text that has no id at all"), (None, "a text that has no id at all")]
    got = corpus_pipeline.near_dedup(spark, docs(rows).select(*corpus_pipeline.COLUMNS), SF).collect()
    assert sorted(((r.doc_id, r.text[:4]) for r in got), key=repr) == [(1, "same"), (3, "anot"), (None, "a te")]


def brute_kept(rows):
    """What stays of (doc_id, text) rows: of each component of fingerprints the smallest id's text of smallest digest."""
    roots, best = brute_components([brute_fingerprint(t) for _, t in rows]), {}
    for (i, t), r in zip(rows, roots):
        place = (i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest())
        best[r] = min(best.get(r, (place, i, t)), (place, i, t), key=lambda x: x[0])
    return sorted(((i, t) for _, i, t in best.values()), key=repr)


def test_an_id_with_unlike_texts_is_decided_by_text(spark, docs):
    rng = random.Random(4)
    base = [[f"{x}{i}" for i in range(rng.randint(1, 400))] for x in "abcdefgh"]
    rows = []
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["other", "word", "é"])
        rows.append((rng.choice([None, 1, 2, 3, 5, 8, 13, 21]), " ".join(words)))
    rows += [(3, None), (2, ""), (None, None), (8, "a 1"), (8, "a 1")] + rows[:20]
    got = corpus_pipeline.near_dedup(spark, docs(rows).select(*corpus_pipeline.COLUMNS), SF).collect()
    want = brute_kept(rows)
    assert sorted(((r.doc_id, r.text or "") for r in got), key=repr) == sorted(((i, t or "") for i, t in want), key=repr)
    assert len(got) < len({t for _, t in rows}) and len({r.doc_id for r in got}) < len(got)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_empty_tables_and_very_long_texts(spark, docs, tmp_path, name, stage):
    """Nothing in, nothing out; labels and benchmark may be empty, too; a text of 300,000 words is one document."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    clashing = docs([]).withColumnRenamed("fp", "root")
    for folder in (SF, str(tmp_path)):
        assert stage(spark, clashing, folder).count() == 0
    good = "the words of the text and more of the same kind "
    long = [(1, good * 30_000, "en", "s"), (2, good, "en", "s"), (2, good, "en", "s"), (None, good * 3, "en", "s")]
    frame = docs(long).withColumnRenamed("fp", "root").withColumnRenamed("shard", "__text").withColumnRenamed("u", "__language")
    out = stage(spark, frame, str(tmp_path))
    assert out.count() == (len({brute_fingerprint(r[1]) for r in long}) if name == "SimHash near-dedup" else 4)
    if name != "BPE encoding":
        assert tuple(out.columns) == corpus_pipeline.COLUMNS


def test_noise_and_unlearned_languages_are_rejected(spark):
    import random
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=600)), "".join(rng.choices("0123456789abcdef", k=600)), "qzx kvw jjp",
           "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Все люди рождаются свободными и равными", "人人生而自由在尊严和权利上一律平等"]
    more = spark.createDataFrame([(-1 - i, t, None, "odd", len(t)) for i, t in enumerate(odd)], docs.select(*corpus_pipeline.COLUMNS).schema)
    got = corpus_pipeline.language_id(spark, docs.select(*corpus_pipeline.COLUMNS).union(more), SF)
    clean = docs.filter(F.col("text").rlike(r"\p{L}")).count()
    assert got.filter("source = 'odd'").count() == 0
    assert got.count() > 0.99 * clean

import random
import re

import numpy as np

from crosstally.llm import decontam

ITEM = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    wins = []
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        wins += [(i, w[s:s + n]) for s in range(len(w) - n + 1)] if n else []
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    ids.add(i)
        ids.discard(None)
        out.append((d, len(w), len(hit), len(ids), sorted(map(str, ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, token string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n int")
    got = decontam.contamination(d, i).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got], key=repr)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["the", "of", "Å", "x1", "longerthaneightletters", "longerthanEIGHTletterz", "été", "　", "a b"] + [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 30, 60, 60])]
    items += [(100, ITEM), (9, items[8][1]), (None, "only without id here"), (200, None), (201, " .,!"), (202, "the of the of the of the of the of the of the")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [rng.choice(["-", " ", "!\n"]).join(w[a:a + rng.randint(1, 40)]).upper().replace("É", "é").replace("Å", "Å"), " ".join(rng.choices(vocabulary, k=rng.randint(0, 300)))]
        docs.append((i, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "..."), (None, ITEM), (500, ITEM), (500, ITEM), (503, "the of " * 3000)]
    want = brute(docs, items)
    for block in (4 << 20, 200):
        monkeypatch.setattr(decontam, "BLOCK", block)
        assert run(spark, docs, items) == want
    assert any(r[2] for r in want) and any(r[2] and not r[5] for r in want)


def test_partial_windows_are_no_hit(spark):
    docs = [(1, ITEM[:ITEM.index(" w12")]), (2, "x " * 400 + ITEM), (3, "x " * 280 + ITEM)]
    assert [(r[0], r[2], r[5]) for r in run(spark, docs, [(1, ITEM)])] == [(1, 0, False), (2, 15, False), (3, 15, True)]


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == []
    assert run(spark, [(1, ITEM)], []) == [(1, 15, 0, 0, [], False)]


def test_common_word_as_an_item_and_a_long_text(spark, monkeypatch):
    """Every word of the long text is an occurrence: a row each, in batches of a fixed size."""
    monkeypatch.setattr(decontam, "TOGETHER", 100)
    docs = [(1, "the cat " * 6000), (2, "The"), (3, None), (4, "cat " + ITEM)]
    items = [(1, "the"), (2, ITEM)]
    assert run(spark, docs, items) == brute(docs, items)
    rows = decontam._occurrences(
        spark.createDataFrame([(0, 5, 1, "the " * 250)], "row long, doc long, hash long, text string"), [1], np.full(1 << decontam.BITMAP - 3, 255, np.uint8), 13)
    found = rows.filter("around is not null").collect()
    assert len(found) == 250 and max(len(r.around) for r in found) == 25 and rows.count() == 251


def test_no_documents_and_no_items(spark):
    assert run(spark, [], [(1, ITEM)]) == [] and run(spark, [(1, ITEM)], []) == [(1, 15, 0, 0, [], False)]

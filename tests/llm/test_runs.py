import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from crosstally.llm import runs
from crosstally.llm.queries import QUERIES, with_planted_runs


SF = "/root/testdata/sf0.001"


def brute(words, least=6, exponent=4):
    """Maximal stretches of equal words q apart, without those that a smaller period explains."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i - start + q
            smaller = any(all(words[start + k] == words[start + k + d] for k in range(n - d)) for d in range(1, q))
            if n >= max(least, exponent * q) and not smaller:
                found.append((start, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def some_words(rng, most=70):
    n, kinds = rng.randint(0, most), rng.randint(1, 4)
    ids = [rng.randrange(kinds) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
        ids = [ids[i] if i < a else ids[a + (i - a) % p] for i in range(n)]
    return [f"w{x}" for x in ids]


def test_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        words = [some_words(rng) for _ in range(rng.randint(1, 6))]
        found, kept = runs.repeated([" ".join(w) for w in words], 6, 4)
        assert found == [brute(w) for w in words]
        assert kept == [collapsed(w, f) for w, f in zip(words, found)]


def test_automaton_runs_need_no_narrowing():
    rng = random.Random(6)
    for _ in range(200):
        words = some_words(rng)
        assert sorted(runs.runs_of([int(w[1:]) for w in words], 2, 2)) == sorted(brute(words, 2, 2))


def test_tree_of_suffixes():
    """Every suffix of every prefix is on that prefix's path, each length in one state."""
    rng = random.Random(7)
    for _ in range(50):
        ids = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        link, length, ends = runs.automaton(ids)
        for i, v in enumerate(ends):
            assert length[v] == i + 1
            while link[v] >= 0:
                assert length[link[v]] < length[v]
                v = link[v]
            assert v == 0


def test_access_tells_the_last_ends():
    rng = random.Random(8)
    ids = [rng.randrange(2) for _ in range(60)]
    link, length, ends = runs.automaton(ids)
    paths = runs.Accesses(link)
    for i, v in enumerate(ends):
        for node, before in paths.access(v, i):
            n = length[node]
            earlier = [j for j in range(i) if ids[j - n + 1:j + 1] == ids[i - n + 1:i + 1] and j >= n - 1]
            assert before == (max(earlier) if earlier else -1) or (n == 0 and before == i - 1)


@pytest.mark.parametrize("text,want", [(None, []), ("", []), (" \t\n", []), ("a", []), ("a a a a a", []), ("a a a a a a", [(0, 6, 1)]), ("x a b a b a b a b y", [(1, 8, 2)]),
                                       ("a b a b a b a c", []), ("É é É é É é É é", [(0, 8, 2)]), ("a a " * 6, [(0, 6, 1)])])
def test_edges(text, want):
    found, kept = runs.repeated([text], 6, 4)
    assert found == [want]
    assert kept == [collapsed(re.findall(r"[^\x20\x09-\x0D]+", text or ""), want)]


def test_very_long_texts():
    words = ["w"] * 300_000
    found, kept = runs.repeated([" ".join(words), " ".join(f"v{i % 7}" for i in range(100_000)), " ".join(map(str, range(200_000)))], 6, 4)
    assert found == [[(0, 300_000, 1)], [(0, 100_000, 7)], []]
    assert [len(k.split()) for k in kept] == [1, 7, 200_000]


def test_frames(spark, docs):
    rows = [(1, "a a a a a a b"), (1, "a a a a a a b"), (None, "no id no id no id no id"), (2, None), (3, "")]
    got = Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in runs.with_runs(docs(rows)).collect())
    assert got == Counter({(1, ((0, 6, 1),), "a b"): 2, (None, ((0, 8, 2),), "no id"): 1, (2, (), ""): 1, (3, (), ""): 1})
    assert runs.with_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        runs.with_runs(docs([]), exponent=3)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(source)
    some = 0
    for d in source:
        words = planted(d.doc_id, d.text)
        if len(words) > 3000:
            continue
        found, r = brute(words), got[d.doc_id]
        some += bool(found)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(found), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert some > 5


def test_planted_runs_keep_all_rows(spark, docs):
    rows = [(i, t) for i in range(60) for t in ("a b c d e f g h", None, "", "  x  ")] + [(None, "y")]
    got = sorted(((r.doc_id, (r.text or "").split()) for r in with_planted_runs(docs(rows)).collect()), key=repr)
    assert got == sorted(((i, planted(i, t) if i is not None else (t or "").split()) for i, t in rows), key=repr)

import random
import re

import numpy as np
import xxhash

from crosstally.llm import simhash
from crosstally.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    near, wide = simhash.error_patterns()
    assert set(np.bitwise_count(near)) == {0, 1, 2, 3}
    # Weight-3 cosets have five more words of weight 4, the others none.
    more = (wide != near[:, None]).sum(axis=1)
    assert set(more[np.bitwise_count(near) == 3]) == {5} and set(more[np.bitwise_count(near) < 3]) == {0}
    words = np.arange(0, 1 << 23, 997)
    assert not simhash._syndrome(words ^ near[simhash._syndrome(words)]).any()


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    stored, asked = simhash.golay_keys(a)[0], simhash.golay_keys(b)[1]
    for s, q in zip(stored, asked):
        assert (set(s) & set(q)) - {-1}


def test_fingerprint_equals_bit_by_bit_votes():
    for text in ("", None, " \t\n", "one", "Two Words", "a b c", "a b c a b c d", "É é A b c d", "x " * 500 + "y z", "w\x1cv u t"):
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def test_near_duplicates_against_all_pairs(spark, docs):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefg", k=4)) for _ in range(300)]
    rows, n = [], 0
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.choice([2, 30, 400]))
        for _ in range(rng.randint(1, 5)):
            near = list(words)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((1000 - n, " ".join(near)))
            n += 1
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, rows[0][1]), (None, rows[0][1]), (rows[0][0], rows[0][1]), (None, "only here so")]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert got[0].__fields__ == ["doc_id", "fingerprint", "component_id"]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {r: min([rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None], default=None) for r in roots}
    want = [(rows[i][0], f"{fps[i]:016x}", least[roots[i]]) for i in range(len(rows))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len(set(roots)) < len(set(fps)) < len(rows)


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}

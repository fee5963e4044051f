import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import pyspark.sql.functions as F

from crosstally.llm import prefix_trie
from crosstally.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, turns string, path int, n string"


def brute(paths):
    """Figures of all nodes, from {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = {p: [q for q in members if q[:len(p)] == p] for p in members}
    kids = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below[p]),
                   sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q),
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def rows(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def some(rng, n, kinds, longest):
    return {c: [(rng.choice("ua"), rng.choice(["", "é", "word", "more words"][:kinds])) for _ in range(rng.randint(1, longest))] for c in rng.sample(range(-20, 900), n)}


def frame(spark, paths):
    return spark.createDataFrame([(c, k, role, text, "x", 1, "y") for c, turns in paths.items() for k, (role, text) in enumerate(turns)], SCHEMA)


@pytest.mark.parametrize("seed,n,kinds,longest,turns_per_shard,deepest", [(1, 120, 2, 5, 1 << 14, 32), (2, 120, 2, 6, 20, 32), (3, 150, 4, 4, 10, 2), (4, 60, 1, 12, 5, 3), (5, 40, 4, 2, 1, 1)])
def test_equals_brute_force(spark, seed, n, kinds, longest, turns_per_shard, deepest):
    rng = random.Random(seed)
    paths = some(rng, n, kinds, longest)
    # A third of all conversations are the same one.
    hot = next(iter(paths.values()))
    paths |= {1000 + c: hot for c in range(n // 2)}
    lists = prefix_trie.turn_lists(frame(spark, paths))
    assert rows(prefix_trie.nodes(lists, turns_per_shard, deepest)) == brute(paths)


def test_walk_in_any_number_of_shards():
    """The shards' rows and partials add up to the same sums however the paths are cut."""
    rng = random.Random(9)
    for _ in range(100):
        paths = sorted({bytes(rng.randrange(2) for _ in range(rng.randint(0, 5))) for _ in range(20)})
        wide = [b"".join(bytes([b] * prefix_trie.DIGEST) for b in p) for p in paths]
        splitters = sorted({p[:3 * prefix_trie.DIGEST] for p in rng.sample(wide, 4)} - {b""})
        child, parents = prefix_trie.skeleton_of(splitters)
        found = []
        for shard in range(len(splitters) + 1):
            own = [p for p in wide if prefix_trie.bisect_right(splitters, p) == shard]
            found += prefix_trie.walk(((p, [3] * 9, 1, i, "e") for i, p in enumerate(own)), child)
        inner = [r for r in found if r[0] is None]
        nodes = {p[:k] for p in wide for k in range(0, len(p) + 1, prefix_trie.DIGEST)}
        skeleton = {p[:k] for p in splitters for k in range(0, len(p) + 1, prefix_trie.DIGEST)} | {b""}
        assert len(inner) == len(nodes - skeleton) and len(parents) == len(skeleton)
        assert sum(r[6] for r in found if r[0] == 0) == len(wide)


def test_common_turns():
    d = prefix_trie.DIGEST
    a = b"".join(bytes([i % 250]) * d for i in range(999))
    for k in (0, 1, 5, 998):
        assert prefix_trie.common(a, a[:k * d] + b"\xff" * d) == k
    assert prefix_trie.common(a, a) == 999 and prefix_trie.common(a, a[:10 * d]) == 10 and prefix_trie.common(b"", a) == 0


def test_equal_paths_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 7)
    ids = list(range(100, 0, -1))
    rows_ = spark.createDataFrame([("p", i) for i in ids] + [("q", 5)], "path_id string, conv_id long").repartition(5)
    got = sorted((r.path_id, r.n, r.least, r.ends_sha256) for r in prefix_trie._ends(rows_).collect())
    assert got == [("p", 100, 1, hashlib.sha256(",".join(map(str, range(1, 101))).encode()).hexdigest()), ("q", 1, 5, hashlib.sha256(b"5").hexdigest())]


def test_nulls_ties_repeats_and_long_conversations(spark):
    data = [(1, None, None, None), (1, 2, "u", "b"), (1, 1, "u", "a"), (2, 0, "", ""), (2, 1, "u", "a"), (2, 2, "u", "b"), (None, 0, "u", "lost"),
            (3, 5, "u", "same"), (3, 5, "u", "same")] + [(7, k, "u", "long") for k in range(3000)] + [(8, k, "u", "long") for k in range(2999)]
    paths = {1: [("", ""), ("u", "a"), ("u", "b")], 3: [("u", "same")] * 2, 7: [("u", "long")] * 3000, 8: [("u", "long")] * 2999}
    paths[2] = paths[1]
    got = rows(prefix_trie.nodes(prefix_trie.turn_lists(spark.createDataFrame([(*r, "x", 1, "y") for r in data], SCHEMA)), 50))
    short = {c: p for c, p in paths.items() if c < 7}
    assert len(got) == 1 + 3 + 2 + 3000
    assert [r for r in got if r[0] < 7 and r[1]] == [r for r in brute(short) if r[1]]
    root = next(r for r in got if not r[1])
    assert root[:6] == (1, 0, None, 5, 3, 3) and root[6] == 1 + 1 + 2999 * 4
    assert next(r for r in got if r[:2] == (7, 2999))[3:7] == (2, 1, 1, 4) and next(r for r in got if r[:2] == (7, 3000))[3:7] == (1, 0, 1, 0)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.nodes(prefix_trie.turn_lists(empty)).count() == 0


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def test_shared_heads(spark):
    rng = random.Random(11)
    own = {c: t for c, t in some(rng, 150, 4, 12).items() if c >= 0}
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    lists = prefix_trie.with_shared_heads(prefix_trie.turn_lists(frame(spark, own)), 5, head, 8)
    paths = rebuilt(own)
    assert any(not t for t in paths.values())
    assert rows(prefix_trie.nodes(lists, 40, 3)) == brute(paths)


def test_query_against_brute_force(spark):
    own = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: r.turn):
        own[r.conv_id].append((r.role or "", r.text or ""))
    assert rows(QUERIES["op12_prefix_trie"](spark, SF)) == brute(rebuilt(own))

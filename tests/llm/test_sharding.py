import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

from crosstally.llm import sharding


def brute_shard(key, weights):
    """Smallest -ln(u)/w with Spark's xxhash64 of a long, then an int (each hash seeds the next)."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    costs = []
    for s, w in enumerate(weights):
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11) + 0.5) / 2 ** 53
        costs.append((-math.log(u) / w if w else math.inf, s))
    return min(costs)[1]


def test_against_brute_force(docs):
    rows = [(i * 37, "text é %d" % (i % 5)) for i in range(600)] + [(None, "n"), (None, None), (3, ""), (3, ""), (3, None)]
    got = sharding.shards(docs(rows), [1.0] * 40).collect()
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", brute_shard(k, [1] * 40), brute_shard(k, [1] * 41)) for k, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_row_that_is_most_of_the_table(docs, monkeypatch):
    """Copies become counts of short stretches; slots stay gapless whatever the stretches."""
    for copies in (16, 1 << 16):
        monkeypatch.setattr(sharding, "COPIES", copies)
        rows = [(7, "same")] * 700 + [(i, "other") for i in range(300)] + [(7, "unlike")] * 5
        got = sharding.shards(docs(rows), [1.0] * 4).collect()
        assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((k, zlib.crc32(t.encode())) for k, t in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights(spark):
    keys = spark.range(8000)
    weights = [1.0, 2.0, 0.0, 5.0]
    got = keys.select("id", sharding.rendezvous(keys.id, weights).alias("s")).collect()
    assert all(r.s == brute_shard(r.id, weights) for r in got[:300])
    share = Counter(r.s for r in got)
    assert share[2] == 0 and abs(share[3] / 8000 - 5 / 8) < 0.03 and abs(share[1] / 8000 - 2 / 8) < 0.03


def test_moves_only_into_the_new_shard(spark):
    keys = spark.range(5000)
    r = keys.select(sharding.rendezvous(keys.id, [1.0] * 10).alias("a"), sharding.rendezvous(keys.id, [1.0] * 11).alias("b")).collect()
    moved = [x for x in r if x.a != x.b]
    assert all(x.b == 10 for x in moved) and 0.06 < len(moved) / 5000 < 0.12


def test_empty_and_written(spark, docs, tmp_path):
    assert sharding.shards(docs([]), [1.0]).count() == 0
    frame = docs([(i, "t") for i in range(50)]).drop("shard")
    sharding.write_shards(frame, str(tmp_path / "s"), [1.0] * 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and all(r["shard"] == brute_shard(r.doc_id, [1] * 4) for r in back.collect())


def test_plan_is_free_of_python(docs):
    plan = sharding.shards(docs([(1, "a")]), [1.0] * 40)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

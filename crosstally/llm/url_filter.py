"""URL filtering by Bloom filter cascades: exact list membership without a join.

A rule is a host and the beginning of a path. Every URL yields candidate keys: its host's last labels and its
path's first characters, in the label counts and lengths that occur in the rules. A key is listed or not, and
the corpus's distinct candidate keys are the complete universe. A cascade over that universe answers
membership exactly: level 1 holds the listed keys, level 2 the unlisted keys that level 1 lets pass by
mistake, level 3 the listed keys that level 2 lets pass, and so on until nothing passes wrongly. A key outside
level n (counted from 1) is unlisted for odd n and listed for even n; a key in all levels belongs to the kind
the last level holds.

The universe is two hashes of each distinct key, written once; each level is an aggregate of set bits. A level
is as large as the listed keys need (about 1.44 bits times the logarithm of the inverse error rate for each),
not as the corpus. The filters go to the tasks by broadcast; their size is computed first, and a list that
needs more than ``most_bytes`` is cut into parts by the key's hash, each with a cascade of its own, looked up
one after the other. No key is left out at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import materialise

MASK = (1 << 64) - 1


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Level(NamedTuple):
    salt: int
    bits: int
    hashes: int
    words: np.ndarray


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mixed(h1, h2, salt: int, i: int, bits: int):
    """Position of hash number i in a level: double hashing of two 64-bit hashes with the level's salt."""
    odd = np.uint64((2 * salt + 1) * 0x9E3779B97F4A7C15 & MASK)
    x = (h1 ^ odd) + (h2 * odd | np.uint64(1)) * np.uint64(i)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) % np.uint64(bits)


def positions(h1: np.ndarray, h2: np.ndarray, level: Level) -> np.ndarray:
    """(keys, hashes) bit positions of keys in a level."""
    h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
    return np.stack([_mixed(h1, h2, level.salt, i, level.bits) for i in range(level.hashes)], axis=1)


def passes(h1: np.ndarray, h2: np.ndarray, level: Level) -> np.ndarray:
    p = positions(h1, h2, level)
    return ((level.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1) if len(p) else np.zeros(0, bool)


def shape(keys: int, others: int, deeper: bool) -> tuple[int, int]:
    """Bits and hash functions of a level. The first lets so few of the others pass that they are about as
    many as the listed keys; the deeper ones let half of what is left pass."""
    rate = 0.5 if deeper else min(0.5, max(keys, 1) * math.sqrt(0.5) / max(others, 1))
    hashes = max(1, round(math.log2(1 / rate)))
    return max(64, math.ceil(max(keys, 1) * hashes / math.log(2))), hashes


def member(h1: np.ndarray, h2: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Whether keys of the universe are listed."""
    listed, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for n, level in enumerate(levels):
        inside = passes(h1[open_], h2[open_], level)
        listed[open_[~inside]] = n % 2 == 1
        open_ = open_[inside]
    listed[open_] = len(levels) % 2 == 1
    return listed


def _build(keys: DataFrame, level: Level) -> Level:
    """The level with the bits of ``keys`` set. At most one row for each 64-bit word reaches the driver."""
    def run(batches):
        for frame in batches:
            p = positions(frame.h1.to_numpy(), frame.h2.to_numpy(), level).ravel()
            words, at = np.unique(p >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (p & np.uint64(63)))
            yield pd.DataFrame({"word": words.astype(np.int64), "bits": bits.view(np.int64)})

    words = np.zeros((level.bits + 63) // 64, np.uint64)
    set_bits = keys.select("h1", "h2").mapInPandas(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = set_bits.toPandas()
    words[found.word.to_numpy()] = found.bits.to_numpy().view(np.uint64)
    return level._replace(words=words)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for frame in batches:
            yield frame[passes(frame.h1.to_numpy(), frame.h2.to_numpy(), shared.value)]

    return materialise(keys.select("h1", "h2").mapInPandas(run, "h1 bigint, h2 bigint"), "passing")


def cascade(listed: DataFrame, others: DataFrame) -> list[Level]:
    """Levels for two disjoint sets of distinct keys ``(h1, h2)``. No listed keys: no levels, nothing is listed."""
    mine, theirs = (listed, listed.count()), (others, others.count())
    levels: list[Level] = []
    while mine[1]:
        bits, hashes = shape(mine[1], theirs[1], deeper=bool(levels))
        levels.append(_build(mine[0], Level(len(levels), bits, hashes, np.zeros(0, np.uint64))))
        wrong = _passing(theirs[0], levels[-1])
        mine, theirs = (wrong, wrong.count()), mine
    return levels


def is_listed(df: DataFrame, h1: list[str], h2: list[str], levels: list[Level]) -> list[Column]:
    """For each pair of hash columns whether that key is listed; a null hash is never listed."""
    shared = df.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def look_up(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(member(a.to_numpy(), b.to_numpy(), shared.value))

    zero = F.lit(0).cast("bigint")  # a null among longs would reach pandas as a float
    return [F.col(a).isNotNull() & look_up(F.coalesce(F.col(a), zero), F.coalesce(F.col(b), zero)) for a, b in zip(h1, h2)]


def with_membership(df: DataFrame, keys: list[str], lists: dict[str, DataFrame], most_bytes: int = 64 << 20) -> DataFrame:
    """Adds ``<key>_<list>`` for each string column in ``keys`` and each list (a frame with a column ``key``):
    whether the value is in the list. Exact for every row of ``df``: the universe is all values of those
    columns. Null is in no list."""
    second = F.lit(1)
    hashed = df.select("*", *[c for k in keys for c in (
        F.when(F.col(k).isNotNull(), F.xxhash64(k)).alias(f"{k}_h1"),
        F.when(F.col(k).isNotNull(), F.xxhash64(F.reverse(k), second)).alias(f"{k}_h2"))])
    pairs = F.explode(F.array(*[F.struct(F.col(f"{k}_h1").alias("h1"), F.col(f"{k}_h2").alias("h2")) for k in keys]))
    universe = materialise(hashed.select(pairs.alias("p")).select("p.*").filter("h1 is not null").distinct(), "key-universe")
    out = hashed
    for name, listed in lists.items():
        wanted = materialise(listed.filter("key is not null").select(
            F.xxhash64("key").alias("h1"), F.xxhash64(F.reverse("key"), second).alias("h2")).distinct(), "listed-keys")
        others = materialise(universe.join(wanted, ["h1", "h2"], "left_anti"), "unlisted-keys")
        n, m = wanted.count(), others.count()
        bits, _ = shape(n, m, deeper=False)
        parts = max(1, math.ceil((bits + 6 * n) / 8 / most_bytes))  # the deeper levels need under six bits a listed key
        out = out.withColumns({f"{k}_{name}": F.lit(False) for k in keys})
        for part in range(parts):
            of_part = F.pmod(F.col("h1"), F.lit(parts)) == part
            levels = cascade(wanted.filter(of_part), others.filter(of_part))
            found = is_listed(out, [f"{k}_h1" for k in keys], [f"{k}_h2" for k in keys], levels)
            here = [F.pmod(F.col(f"{k}_h1"), F.lit(parts)) == part for k in keys]
            out = out.withColumns({f"{k}_{name}": F.when(h, f).otherwise(F.col(f"{k}_{name}")) for k, h, f in zip(keys, here, found)})
    return out.drop(*[f"{k}_h{i}" for k in keys for i in (1, 2)])


def candidate_keys(rules: Iterable[Rule]) -> list[tuple[int, int]]:
    """(host labels, path length) of the rules: the shapes in which a URL can be listed."""
    return sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins (then the
    longer host), a key listed as block and as allow blocks. A URL that no rule fits is not on the list and
    gets ``default``. A null URL or one without ``://`` has an empty host and path and fits no rule. Rows are
    independent of each other, so repeated rows and null keys simply come back; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    u = F.col(f"`{url}`").cast("string")
    parsed = pages.select(F.col(f"`{key}`").alias("__key"), host_of(u).alias("host"), path_of(u).alias("path"))
    shapes = candidate_keys(rules)
    if not shapes:
        return parsed.select(F.col("__key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    columns, hosts = [], {}
    for i, (labels, length) in enumerate(shapes):
        end = F.substring_index("host", ".", -labels)
        fits = (F.size(F.split("host", r"\.")) >= labels) & (F.char_length("path") >= length) & (F.col("host") != "")
        hosts[f"k{i}"] = end
        columns.append(F.when(fits, F.concat(end, F.left("path", F.lit(length)))).alias(f"k{i}"))
    keyed = parsed.select("*", *columns)
    names = list(hosts)
    lists = {v: spark.createDataFrame([(r.host + r.path,) for r in rules if r.verdict == v], "key string") for v in ("block", "allow")}
    keyed = with_membership(keyed, names, lists)
    hits = F.filter(F.array(*[F.struct(
        F.char_length(k).alias("length"), F.char_length(hosts[k]).alias("host_length"), F.col(f"{k}_block").alias("block"), F.col(k).alias("rule"),
        (F.col(f"{k}_block") | F.col(f"{k}_allow")).alias("listed")) for k in names]), lambda x: x["listed"])
    best = F.array_max(hits)
    verdict = F.when(best.isNull(), F.lit(default)).when(best["block"], F.lit("block")).otherwise(F.lit("allow"))
    return keyed.select(F.col("__key").alias(key), "host", "path", best["rule"].alias("rule"), verdict.alias("verdict"))

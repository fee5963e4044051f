"""Near-duplicate detection by SimHash fingerprints and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded with zeros). The perfect
Golay code (23,12) has a codeword within three bits of every 23-bit word. Its index is the segment's
*near* key; the indices of all codewords within four bits (one or six of them) are its *wide* keys. Two
segments that differ in at most one bit share a key: the near key of either one is a wide key of the other.

Pigeonhole: at most three differing bits over three segments leave two segments with at most one each. For
each of the three pairs of segments (i, j) a fingerprint is therefore stored under (near i, every wide j)
and looked up under (every wide i, near j). Both are 24-bit keys, at most 36 rows for a fingerprint; a join
on the key finds every linked pair and the join condition verifies the differing bits.

Equal fingerprints are grouped first, so a text with a million copies is one row of the join, and only links
between different fingerprints are written. A fingerprint has at most 43,744 others within three bits,
however many documents there are.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import materialise
from .components import connected_components

# Generator of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and the contract's seed.
GENERATOR = 0b101011100011
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
SHINGLES_AT_ONCE = 1 << 16


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space. ``bytes`` methods touch ASCII only."""
    return text.encode("utf-8").lower().split()


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of all ``size``-word shingles, repeats included; a shorter text is one shingle, none gives 0."""
    words = words_of(text) if text else []
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(size))) if len(words) >= size else (words,)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = np.array([digest(join(s), SEED) for s in shingles], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at:at + SHINGLES_AT_ONCE].astype("<u8", copy=False)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 3) -> DataFrame:
    """The ``keep`` columns of every row and its fingerprint ``fp`` (the 64 bits as a long)."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, size) for t in batch.column(len(keep)).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, fp bigint")


def digits(fp: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes: the pattern of at most three bits, and all patterns of at most four
    bits (up to six, the first one repeated where there are fewer)."""
    bits = np.array([1 << i for i in range(23)])
    layers = [np.zeros(1, np.int64)]
    for _ in range(4):
        wider = (layers[-1][:, None] | bits[None, :]).ravel()
        layers.append(np.unique(wider[np.bitwise_count(wider) == len(layers)]))
    near = np.zeros(2048, np.int64)
    for layer in layers[:4]:
        near[_syndrome(layer)] = layer
    wide = np.repeat(near[:, None], 6, axis=1)
    four = layers[4][np.argsort(_syndrome(layers[4]), kind="stable")]
    syndrome = _syndrome(four)
    place = np.arange(len(four)) - np.searchsorted(syndrome, syndrome)
    wide[syndrome, place + 1] = four
    return near, wide


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which fingerprints are stored and looked up: two arrays of (rows, 18) longs, -1 where a
    segment has fewer than six wide keys."""
    near_of, wide_of = error_patterns()
    near, wide, fewer = [], [], []
    for start, width in SEGMENTS:
        segment = ((fps >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = _syndrome(segment)
        near.append((segment ^ near_of[s]) >> 11)
        wide.append((segment[:, None] ^ wide_of[s]) >> 11)
        fewer.append(np.hstack([np.zeros((len(fps), 1), bool), wide_of[s][:, 1:] == near_of[s][:, None]]))
    stored, asked = [], []
    for n, (i, j) in enumerate(PAIRS):
        stored.append(np.where(fewer[j], -1, n << 24 | near[i][:, None] << 12 | wide[j]))
        asked.append(np.where(fewer[i], -1, n << 24 | wide[i] << 12 | near[j][:, None]))
    return np.hstack(stored), np.hstack(asked)


def _keyed(fps: DataFrame, which: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 1 << 14):
                part = fp[at:at + (1 << 14)]
                keys = golay_keys(part.view(np.uint64))[which]
                row, _ = used = np.nonzero(keys >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[used].astype(np.int32)), pa.array(part[row])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key int, fp bigint")


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints that differ in at most ``bits`` (3 at most) bits.
    A pair may be found under several keys and then comes several times."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys are complete for at most three differing bits")
    stored = _keyed(fps, 0).select("key", F.col("fp").alias("a"))
    asked = _keyed(fps, 1).select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return stored.join(asked, (stored.key == asked.key) & (F.col("a") < F.col("b")) & near).select("a", "b")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, bits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``key``, the ``keep`` columns, ``fp`` (the fingerprint as a long), ``root`` (the
    smallest fingerprint of the component, which stands for it) and ``component_id``; see :func:`near_duplicates`."""
    rows = materialise(with_fingerprint(docs, text, (key, *keep), size).withColumnRenamed(key, "__key"), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("__key").alias("least")), "distinct-fingerprints")
    members = connected_components(links(fps, bits), "a", "b")
    # Without links a fingerprint is its own component; with links the least key is taken over all members.
    linked = members.join(fps, members.node == fps.fp).select("root", "fp", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = materialise(linked.select("root", "fp").join(least, "root").select("fp", "root", "component_id"), "components")
    alone = fps.join(of_linked, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    component = materialise(of_linked.unionByName(alone), "component-of-fingerprint")
    return rows.join(component, "fp").select(F.col("__key").alias(key), *[F.col(f"`{c}`") for c in keep], "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; ``component_id`` is the smallest
    key reachable over links. Null or blank texts have fingerprint 0 and are linked like any other. Null keys
    do not count for the smallest key (a component of null keys only has a null id); repeated rows are kept
    and share their component. A long text is hashed whole in one task, its shingles in blocks. Other columns
    are ignored, whatever their names.
    """
    return groups(docs, key, text, size, bits).select(f"`{key}`", digits("fp").alias("fingerprint"), "component_id")

"""Language-model scoring from a log-frequency Bloom filter of n-gram counts.

The model is a bigram model with a Dirichlet prior over word frequencies: P(t | h) = (c(h t) + K P(t)) / (c(h) + K).
Its counts come from a Bloom filter that holds, for an n-gram met c times, the entries (n-gram, 1) .. (n-gram, q) with
q = 1 + floor(log_b c). Probing (n-gram, 1), (n-gram, 2) .. until one is missing gives q back, and with it the count
but for its rounding; a false positive can only raise q, mostly by one.

A text is a ring: the end of a text stands before its first word. So every token is a history once, and the sum over
a text splits by tokens: each adds log10(c(h t) + K P(t)) - log10(c(t) + K), which needs the counts of t and of the pair
only. The filter is cut into parts by token (a token with very many occurrences into several, by history), and a part
holds both. A part is about ``TOKENS_PER_PART`` occurrences, however large the corpus, and its filter is as large as
its own entries need. Parts are broadcast in groups of at most ``most_bytes``; texts are passed once for each
group, and a token is scored in its group's pass.

All tokens of the training texts are counted. Pair counts leave the tasks as blocks of 48-bit hashes, sorted and
summed up, one block a part. Exact counts (for the base score and the known tokens) are a Spark table: the most
frequent tokens, at most ``most_heavy`` of 64 bytes each, are looked up in the tasks; the rest is joined, summed up by
text before.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.sinks import materialise

END = b" "  # no word holds a space
SEED = 42
TOKENS_PER_PART = 1 << 20
# A token of this many occurrences is cut into parts by history.
OCCURRENCES = 1 << 19
TEXT_AT_ONCE = 1 << 21
ROWS_AT_ONCE = 500
BASE = 1.5
BITS_PER_ENTRY, BITS_SET = 10, 4
MOST_LEVELS = 120  # of BASE 1.5: counts up to 10^21
SMALLEST = 0.1  # what is added to every count, as the base score has it


class Block(NamedTuple):
    """Tokens of some texts: numbers of the distinct ones, each text followed by the end (number 0)."""
    ids: np.ndarray
    ends: np.ndarray
    words: list[bytes]


def blocks(texts: pa.Array, most: int = TEXT_AT_ONCE):
    """Blocks of about ``most`` characters of whole texts, with the number of texts in each."""
    held, size = [], 0
    for at in range(0, len(texts), ROWS_AT_ONCE):
        for text in texts.slice(at, ROWS_AT_ONCE).to_pylist():
            held.append(text)
            size += len(text or "")
            if size >= most:
                yield len(held), _block(held)
                held, size = [], 0
    if held:
        yield len(held), _block(held)


def _block(texts: list[str | None]) -> Block:
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[END] = 0
    words = [[*t.encode("utf-8", "surrogatepass").lower().split(), END] if t else [END] for t in texts]
    ends = np.cumsum([len(w) for w in words])
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(ends[-1]))
    return Block(ids, ends, list(number))


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keys:
    """Where n-grams are kept: the part, and 48 bits (or what is left of 64) that stand for the n-gram in it."""

    def __init__(self, parts: int, heavy: dict[bytes, int]):
        self.parts, self.heavy = parts, heavy
        self.bits = np.uint64(min(48, 64 - (parts - 1).bit_length()))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))

    def pieces(self, words: list[bytes]) -> np.ndarray:
        """Into how many parts each word is cut."""
        return np.fromiter((1 + self.heavy.get(w, 0) // OCCURRENCES for w in words), np.uint64, len(words))

    def part(self, word: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return mixed(word + piece * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.parts)

    def one(self, word: np.ndarray) -> np.ndarray:
        return mixed(word ^ np.uint64(0x5851F42D4C957F2D)) >> (np.uint64(64) - self.bits)

    def two(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mixed(mixed(before) + word) >> (np.uint64(64) - self.bits)

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its part, and the keys of itself and of it behind its predecessor."""
        hashes, pieces = self.hashes(block.words), self.pieces(block.words)
        word, before = hashes[block.ids], np.empty(len(block.ids), np.uint64)
        before[0], before[1:] = hashes[0], word[:-1]
        return self.part(word, before % pieces[block.ids]), self.one(hashes)[block.ids], self.two(before, word)


def six_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def counted_pairs(docs: DataFrame, keys: Keys) -> DataFrame:
    """``part, keys, counts``: blocks of pairs and how often they were met, a byte each (often met ones come again)."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        k = shared.value
        for batch in batches:
            for _, block in blocks(batch.column(0), 2 * TEXT_AT_ONCE):
                part, _, pair = k.of(block)
                found, n = np.unique(part << k.bits | pair, return_counts=True)
                again = -(-n // 255)
                n = np.minimum(255, np.repeat(n, again) - 255 * (np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)))
                found = np.repeat(found, again)
                part, pair = found >> k.bits, found & ((np.uint64(1) << k.bits) - np.uint64(1))
                begins = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
                ends = [*begins[1:].tolist(), len(part)]
                spans = list(zip(begins.tolist(), ends))
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[begins].astype(np.int32)), pa.array([six_bytes(pair[a:b]) for a, b in spans]),
                    pa.array([n[a:b].astype(np.uint8).tobytes() for a, b in spans])], names=["part", "keys", "counts"])

    return docs.mapInArrow(run, "part int, keys binary, counts binary")


def counted_tokens(counts: DataFrame, keys: Keys) -> DataFrame:
    """The same blocks of single tokens, in all parts of each, from their exact counts, eight bytes each."""
    shared = counts.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        k = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            hashes, pieces = k.hashes(words), k.pieces(words).astype(np.int64)
            row = np.repeat(np.arange(len(words)), pieces)
            part = k.part(hashes[row], (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)).astype(np.uint64))
            order = np.argsort(part, kind="stable")
            part, key, n = part[order], k.one(hashes)[row[order]], batch.column(1).to_numpy()[row[order]]
            begins = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
            spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(part)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(part[begins].astype(np.int32)), pa.array([six_bytes(key[a:b]) for a, b in spans]),
                pa.array([n[a:b].astype("<i8").tobytes() for a, b in spans])], names=["part", "keys", "counts"])

    return counts.select("token", "n").mapInArrow(run, "part int, keys binary, counts binary")


def probes(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where an entry is looked up (a hash, to be taken modulo the words of the part) and its bits in that word."""
    x = mixed(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
    bits = np.zeros(len(x), np.uint64)
    for i in range(BITS_SET):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return x >> np.uint64(32), bits


def filter_of(keys: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The filter of one part, in words of 64 bits."""
    levels = np.minimum(MOST_LEVELS, 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64))
    words = np.zeros(1 + int(levels.sum()) * bits_per_entry // 64, np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, bits = probes(keys[levels >= level], level)
        np.bitwise_or.at(words, (at % np.uint64(len(words))).astype(np.int64), bits)
    return words


def filter_parts(found: DataFrame, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """``part, words``: the filters, from the blocks of all counts of each part."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([from_six_bytes(k) for k in part["keys"]])
        counts = np.concatenate([np.frombuffer(c, np.uint8 if len(c) * 6 == len(k) else "<i8").astype(np.int64) for k, c in zip(part["keys"], part["counts"])])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        words = filter_of(keys[first], np.add.reduceat(counts[order], first), bits_per_entry)
        return pd.DataFrame({"part": [part["part"].iloc[0]], "words": [words.astype("<u8").tobytes()]})

    return found.groupBy("part").applyInPandas(build, "part int, words binary")


class Filter(NamedTuple):
    """A group of parts: the first one's number, where each one's words begin (and the last one's end), the words."""
    first: int
    begins: np.ndarray
    words: np.ndarray

    def counts(self, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts, but for their rounding, of n-grams whose part is in this group."""
        place = part.astype(np.int64) - self.first
        begin = self.begins[place].astype(np.uint64)
        size = (self.begins[place + 1] - self.begins[place]).astype(np.uint64)
        level, open_ = np.zeros(len(keys), np.int64), np.flatnonzero(size > 0)  # a part may be empty
        while len(open_):
            at, bits = probes(keys[open_], level[open_] + 1)
            held = self.words[(begin[open_] + at % size[open_]).astype(np.int64)]
            open_ = open_[((held & bits) == bits) & (level[open_] < MOST_LEVELS)]
            level[open_] += 1
        return ROUNDED[level]


# The middle of the counts that share a level: whole numbers from BASE^(q-1) to below BASE^q. Level 2 of BASE 1.5 is 2.
_LOWEST = np.ceil(BASE ** np.arange(MOST_LEVELS + 1) - 1e-9)
ROUNDED = np.concatenate([[0.0], np.sqrt(_LOWEST[:-1] * np.maximum(_LOWEST[:-1], _LOWEST[1:] - 1))])


class Model(NamedTuple):
    counts: DataFrame         # token, n: exact, in the shared folder
    parts: DataFrame          # part, words: the filter, in the shared folder
    keys: Keys
    tokens: int               # N, ends included
    distinct: int             # V
    parts_at_once: int        # as many parts as surely fit into most_bytes
    prior: float


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, n`` of all tokens, ends included, of the first column's texts."""
    def run(batches):
        known: Counter[bytes] = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.int64())], names=["token", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    known.update(text.encode("utf-8", "surrogatepass").lower().split())
                known[END] += 1
                if len(known) > 1 << 18:
                    yield told()
                    known.clear()
        if known:
            yield told()

    return docs.mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def heavy_tokens(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent tokens of up to 64 bytes: as many eighths of a power of two as hold ``most`` of them."""
    eighth = F.floor(8 * F.log2("n")).cast("int")
    short = counts.filter(F.length("token") <= 64)
    least, total = None, 0
    for low, n in sorted(short.groupBy(eighth.alias("low")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = low
    return {} if least is None else {bytes(t): n for t, n in short.filter(eighth >= least).select("token", "n").collect()}


def train(docs: DataFrame, text: str = "text", prior: float = 256.0, most_heavy: int = 1 << 17, most_bytes: int = 160 << 20,
          bits_per_entry: int = BITS_PER_ENTRY, tokens_per_part: int = TOKENS_PER_PART) -> Model:
    """Counts all texts of ``docs`` (null: empty) into a model. Rows are not told apart: repeated ones count again.
    Without rows the model knows nothing. Other columns are ignored."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    counts = materialise(token_counts(texts), "token-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    keys = Keys(1 + tokens // tokens_per_part, heavy_tokens(counts, most_heavy))
    parts = materialise(filter_parts(counted_pairs(texts, keys).union(counted_tokens(counts, keys)), bits_per_entry), "filter-parts")
    largest = parts.agg(F.coalesce(F.max(F.octet_length("words")), F.lit(1))).first()[0]
    return Model(counts, parts, keys, tokens, distinct, max(1, most_bytes // largest), prior)


def _group(model: Model, first: int) -> Filter:
    """The parts from ``first`` on that are broadcast together, in one array."""
    last = min(model.keys.parts, first + model.parts_at_once)
    mine = model.parts.filter(F.col("part").between(first, last - 1))
    sizes = np.zeros(last - first + 1, np.int64)
    for part, size in mine.select("part", F.octet_length("words")).collect():
        sizes[part - first + 1] = size // 8
    begins = np.cumsum(sizes)
    words = np.zeros(int(begins[-1]), np.uint64)
    for part, held in mine.toLocalIterator():
        words[begins[part - first]:begins[part - first + 1]] = np.frombuffer(held, "<u8")
    return Filter(first, begins, words)


def log_probabilities(block: Block, keys: Keys, group: Filter, tokens: int, distinct: int, prior: float) -> np.ndarray:
    """What each token in this group's parts adds to the log10 probability of its text; 0 for the others."""
    part, one, two = keys.of(block)
    mine = np.flatnonzero((part >= group.first) & (part < group.first + len(group.begins) - 1))
    alone = group.counts(part[mine], one[mine])
    pair = np.minimum(group.counts(part[mine], two[mine]), alone)
    share = (alone + SMALLEST) / (tokens + SMALLEST * (distinct + 1))
    out = np.zeros(len(part))
    out[mine] = np.log10(pair + prior * share) - np.log10(alone + prior)
    return out


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.concatenate([[0], ends[:-1]]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, ``n_tokens`` (its words and one end), ``n_known`` (tokens met in training),
    ``train_tokens``, ``base_score`` (log10 probability by exact token counts) and ``score`` (the model's).

    Null, empty and blank texts are an end only. Repeated rows get the same answer; keys are not looked at and may be
    null or tied. A long text is taken whole in one task. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    names = [*keep, "__text", "__score"]
    held = held.withColumn("__score", F.lit(0.0))
    keys, tokens, distinct, prior = model.keys, model.tokens, model.distinct, model.prior
    whole = tokens + SMALLEST * (distinct + 1)
    firsts = range(0, keys.parts, model.parts_at_once)
    for first in firsts:
        last, shared = first == firsts[-1], spark.sparkContext.broadcast((keys, _group(model, first)))

        def run(batches, last=last, shared=shared):
            k, group = shared.value
            for batch in batches:
                at = 0
                for n, block in blocks(batch.column(len(keep))):
                    part = batch.slice(at, n)
                    at += n
                    added = _per_text(log_probabilities(block, k, group, tokens, distinct, prior), block.ends)
                    total = pa.array(part.column(len(keep) + 1).to_numpy() + added)
                    if not last:
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], total], names=names)
                        continue
                    counts = np.fromiter((k.heavy.get(w, -1) for w in block.words), np.int64, len(block.words))[block.ids]
                    base = _per_text(np.where(counts < 0, 0.0, np.log10((np.maximum(counts, 0) + SMALLEST) / whole)), block.ends)
                    # What is not heavy is left to the join: the distinct tokens of each text.
                    rest = np.flatnonzero(counts < 0)
                    of = np.searchsorted(block.ends, rest, "right")
                    pairs, times = np.unique(of * len(block.words) + block.ids[rest], return_counts=True)
                    offsets = pa.array(np.searchsorted(pairs // len(block.words), np.arange(n + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        *part.columns[:-2], total, pa.array(np.diff(block.ends, prepend=0)), pa.array(_per_text(counts >= 0, block.ends).astype(np.int64)), pa.array(base),
                        pa.ListArray.from_arrays(offsets, pa.array([block.words[i] for i in (pairs % len(block.words)).tolist()], pa.binary())),
                        pa.ListArray.from_arrays(offsets, pa.array(times))], names=[*keep, "__score", "__tokens", "__known", "__base", "__rest", "__times"])

        if last:
            held = held.mapInArrow(run, f"{kept}, __score double, __tokens bigint, __known bigint, __base double, __rest array<binary>, __times array<bigint>")
            held = materialise(held.withColumn("__row", F.monotonically_increasing_id()), "scored-texts")
        else:
            held = materialise(held.mapInArrow(run, f"{kept}, __text string, __score double"), "half-scored-texts")
        shared.destroy()
    rest = held.filter(F.size("__rest") > 0).select("__row", F.explode(F.arrays_zip("__rest", "__times")).alias("r")).select("__row", "r.__rest", "r.__times")
    met = rest.join(model.counts.select(F.col("token").alias("__rest"), "n"), "__rest", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + SMALLEST) / whole)
    added = met.groupBy("__row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("__times")).otherwise(0)).alias("__more"), F.sum(F.col("__times") * log).alias("__log"))
    out = held.join(added, "__row", "left")
    return out.select(
        *[F.col(f"`{c}`") for c in keep], F.col("__tokens").alias("n_tokens"), (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("__base") + F.coalesce("__log", F.lit(0.0))).alias("base_score"), F.col("__score").alias("score"))

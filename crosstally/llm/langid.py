"""Language identification by prediction by partial matching (PPM) over bytes.

Every language has a tree of byte contexts of up to three bytes, counted once and then frozen. A byte that was
seen after a context with d different followers in n visits has probability c / (n + d); one that was not
escapes with d / (n + d) to the context without its first byte, and after the empty context to a uniform
choice among 256 bytes. The code length of a text is the sum of -log2 of these over its bytes. The language
with the shortest code wins; the score is its posterior probability with equal priors.

Counting is a Spark aggregate over all labelled texts (whole; a caller may ask for a sample of them). The driver gets
the counts of the most visited contexts only, as many as the model has room for, and those of shorter ones. What
leaves it is a table of code lengths by context, byte and language, bounded by ``most_bytes``: it goes to the tasks
as a broadcast, and a text is scored with two table look-ups a byte for all languages at once.
A context that was cut or never seen in any language falls back to its longest kept suffix, as PPM does anyway.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import materialise
from .samples import keys_by_hash, rows_of

UNDETERMINED = "und"
LETTER = r"\p{L}"
BLOCK = 1 << 20
# Counts that a counting task holds before it hands them on, and bytes of a model's table.
HELD = 1 << 19
MOST_BYTES = 32 << 20
# Marks the counts of contexts that were cut: their last three bytes only.
SHORT = 1 << 32
# What stands before the first byte of a text.
START = b"\0\0\0"


class Model(NamedTuple):
    languages: list[str]
    symbol: np.ndarray   # byte -> symbol; 0: not seen in training
    context: np.ndarray  # the last three symbols, oldest first -> row of cost
    cost: np.ndarray     # (rows, symbols, languages): code length in bits


def pieces(texts: list[str | None]):
    """Blocks of texts as (bytes, numbers of texts, begins, ends): A-Z lower-cased, each piece behind the
    three bytes before it. A text longer than a block goes on in the next."""
    held, which, begins, ends, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        data = START + text.encode("utf-8", "surrogatepass").lower() if text else START
        for at in range(3, len(data), BLOCK):
            part = data[at - 3:at + BLOCK]
            held.append(part)
            which.append(i)
            begins.append(size + 3)
            size += len(part)
            ends.append(size)
            if size >= BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(which), np.array(begins), np.array(ends)
                held, which, begins, ends, size = [], [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(which), np.array(begins), np.array(ends)


def count_contexts(sample: DataFrame) -> pd.DataFrame:
    """``lang, code, n``: how often four bytes (packed, the last one in the lowest byte) follow each other in the
    texts of a language. ``sample`` has ``lang`` and ``text``."""
    return _counted(sample).toPandas()


def _counted(sample: DataFrame, within: str | None = None) -> DataFrame:
    """The same as a table, for each value of ``within`` (an integer), if named, by itself."""
    by = ["lang", within] if within else ["lang"]

    def merged(parts: list) -> tuple:
        code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return code, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(held: dict):
        for group, parts in held.items():
            code, n = merged(parts)
            yield pd.DataFrame(dict(zip(by, group)) | {"code": code.astype(np.int64), "n": n})

    def run(batches):
        held, size = {}, 0
        for frame in batches:
            for group, texts in frame.groupby(by)["text"]:
                for data, _, begins, ends in pieces(texts.tolist()):
                    # Four bytes are one unsigned number, built in place.
                    codes = np.zeros(len(data), np.uint32)
                    for k in range(4):
                        codes[3:] <<= 8
                        codes[3:] |= data[k:len(data) - 3 + k]
                    inside = np.zeros(len(data) + 1, np.int8)
                    np.add.at(inside, begins, 1)
                    np.add.at(inside, ends, -1)
                    code, n = np.unique(codes[np.cumsum(inside[:-1], dtype=np.int8) > 0], return_counts=True)
                    held.setdefault(group, []).append((code, n))
                    size += len(code)
                    if size >= HELD:
                        held = {g: [merged(parts)] for g, parts in held.items()}
                        size = sum(len(parts[0][0]) for parts in held.values())
                        if size >= HELD // 2:
                            yield from rows(held)
                            held, size = {}, 0
        yield from rows(held)

    more = f"{within} bigint, " if within else ""
    counts = sample.select(*by, "text").mapInPandas(run, f"lang string, {more}code bigint, n bigint")
    return counts.groupBy(*by, "code").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most_bytes: int = MOST_BYTES) -> pd.DataFrame:
    """Of counts as a table what :func:`build` uses of them: those of the contexts of three bytes that were visited most,
    as many as can have room, and of all others the sums by their last three bytes."""
    by_byte = counts.select("lang", F.col("code").bitwiseAND(255).alias("byte")).distinct().collect()
    size, languages = 1 + len({r.byte for r in by_byte}), len({r.lang for r in by_byte})
    if not by_byte:
        return pd.DataFrame({"lang": [], "code": [], "n": []})
    context = F.shiftright("code", 8)
    kept = counts.groupBy(context.alias("context")).agg(F.sum("n").alias("visits")).orderBy(F.desc("visits"), "context").limit(
        most_bytes // (4 * size * languages)).select("context")
    whole = counts.join(kept, context == F.col("context"), "left_semi")
    cut = counts.join(kept, context == F.col("context"), "left_anti").groupBy(
        "lang", (F.col("code").bitwiseAND(0xFFFFFF) + SHORT).alias("code")).agg(F.sum("n").alias("n"))
    # As Arrow whatever the session says: rows would take the driver some hundred bytes each.
    return whole.select("lang", "code", "n").union(cut).toArrow().to_pandas()


def _backed_off(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of the next symbol: seen ones by their counts, the others by escape to the shorter context."""
    visits, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    total = np.maximum(visits + kinds, 1)
    return np.where(visits == 0, shorter, np.where(counts > 0, counts / total, kinds / total * shorter))


def build(counts: pd.DataFrame, most_bytes: int = MOST_BYTES) -> Model | None:
    """Frozen code lengths from the counts; None without counts. Contexts of two bytes and fewer are all kept,
    those of three by how often they were visited, as far as the table stays within ``most_bytes``."""
    if not len(counts):
        return None
    languages = sorted(counts["lang"].unique())
    code = counts["code"].to_numpy()
    n = counts["n"].to_numpy(np.float64)
    language = np.searchsorted(languages, counts["lang"].to_numpy(str))
    parts = [(code >> s & 255) for s in (24, 16, 8, 0)]
    whole = code < SHORT
    used = np.unique(np.concatenate(parts[1:] + [parts[0][whole]]))
    symbol = np.zeros(256, np.int32)
    symbol[used] = np.arange(1, len(used) + 1)
    size = len(used) + 1
    s3, s2, s1, s0 = (symbol[p].astype(np.int64) for p in parts)
    two, at_two = np.unique(s2 * size + s1, return_inverse=True)
    three, at_three = np.unique(np.where(whole, (s3 * size + s2) * size + s1, -1), return_inverse=True)
    visits = np.where(three < 0, 0, np.bincount(at_three, n, len(three)))
    room = max(0, most_bytes // (4 * size * len(languages)) - 1 - size - len(two))
    kept = np.argsort(-visits, kind="stable")[:room]
    kept = np.sort(kept[three[kept] >= 0])
    row_of = np.full(len(three), -1)
    row_of[kept] = np.arange(len(kept))
    three = three[kept]
    cost = np.empty((1 + size + len(two) + len(three), size, len(languages)), np.float32)
    for k in range(len(languages)):
        def table(rows: np.ndarray, height: int) -> np.ndarray:
            mine = (language == k) & (rows >= 0)
            return np.bincount(rows[mine] * size + s0[mine], n[mine], height * size).reshape(height, size)

        p0 = _backed_off(table(np.zeros(len(code), np.int64), 1), np.full((1, size), 1 / 256))
        p1 = _backed_off(table(s1, size), p0)
        p2 = _backed_off(table(at_two, len(two)), p1[two % size])
        p3 = _backed_off(table(row_of[at_three], len(three)), p2[np.searchsorted(two, three % (size * size))])
        cost[:, :, k] = -np.log2(np.concatenate([p0, p1, p2, p3]))
    context = np.zeros((size, size, size), np.int32)
    context[:] = 1 + np.arange(size)
    context[:, two // size, two % size] = 1 + size + np.arange(len(two))
    context.reshape(-1)[three] = 1 + size + len(two) + np.arange(len(three))
    return Model(languages, symbol, context, cost)


def code_lengths(texts: list[str | None], model: Model) -> np.ndarray:
    """(texts, languages): bits that each language's frozen tree needs for each text."""
    size, count = len(model.context), len(model.languages)
    flat, context = model.cost.reshape(-1, count), model.context.reshape(-1)
    bits = np.zeros((len(texts), count))
    for data, which, begins, ends in pieces(texts):
        s = model.symbol[data]
        rows = context[(s[:-3] * size + s[1:-2]) * size + s[2:-1]].astype(np.int64)
        each = np.zeros((len(s) + 1, count), np.float32)
        each[3:-1] = flat[rows * size + s[3:]]
        bounds = np.stack([begins, ends], axis=1).ravel()
        np.add.at(bits, which, np.add.reduceat(each, bounds, axis=0, dtype=np.float64)[::2])
    return bits


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int | None = None) -> Model | None:
    """Learn from all whole texts, or from at most ``docs_per_language`` of each language, those with the smallest
    hash of the key. Of repeated keys the smallest text teaches. Rows without text, key or language teach nothing;
    None if nothing is left."""
    counts = materialise(_counted(_lessons(docs, text, lang, key, docs_per_language)), "context-counts")
    return build(_frequent(counts))


def _lessons(docs: DataFrame, text: str, lang: str, key: str, docs_per_language: int | None) -> DataFrame:
    """``key, lang, text`` of the documents that teach."""
    labelled = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").alias("lang")).dropna()
    if docs_per_language is not None:
        labelled = rows_of(labelled, keys_by_hash(labelled, docs_per_language, within="lang"), "key", "lang")
    # Only texts of repeated keys are brought together.
    repeated = materialise(labelled.groupBy("key", "lang").agg(F.count("*").alias("n")).filter("n > 1").select("key", "lang"), "repeated-keys")
    if repeated.isEmpty():
        return labelled.select("key", "lang", "text")
    first = labelled.join(repeated, ["key", "lang"]).groupBy("key", "lang").agg(F.min("text").alias("text"))
    return labelled.join(repeated, ["key", "lang"], "left_anti").select("key", "lang", "text").union(first)


def highest_rates(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int | None = None) -> dict[str, float]:
    """For each language of what teaches ``train``: the most bits a byte that a text of it may need.

    Each half of these texts is coded by what the other half teaches; the limit is the highest rate met, and eight
    at least: a text beyond it is told better by plain bytes than by the language. A language without texts in
    both halves cannot be measured and has no entry.
    """
    half = (F.crc32(F.col("key").cast("string").cast("binary")) % 2).alias("half")
    lessons = _lessons(docs, text, lang, key, docs_per_language).select("key", "lang", "text", half)
    counted = materialise(_counted(lessons, "half"), "half-counts")
    rates: dict[str, float] = {}
    for n in (0, 1):
        model = build(_frequent(counted.filter(F.col("half") != n).drop("half")))
        if model is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(model)
        coded = predict(lessons.filter(F.col("half") == n), model, into=("__lang", "__score"), rate="__rate", shared=shared)
        for name, most in coded.groupBy("lang").agg(F.max("__rate")).collect():
            if name in model.languages and most is not None:
                rates[name] = max(most, rates.get(name, 8.0))
        shared.destroy()
    return rates


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score"), rate: str | None = None,
            shared: Broadcast | None = None) -> DataFrame:
    """Adds the predicted language and its score (0 to 1) to every row; only the text is looked at. ``rate`` names
    a further column: bits a byte of the text in that language, null for ``und``. ``shared`` is the model as a
    broadcast of the caller's, who can then end it.

    Null, empty and letterless texts (and all texts without a model) are ``und`` with score 0. Ties go to the
    language that sorts first. Repeated rows get the same answer.
    """
    body = F.col(f"`{text}`").cast("string")
    if model is None:
        none = {rate: F.lit(None).cast("double")} if rate else {}
        return docs.withColumns({into[0]: F.lit(UNDETERMINED), into[1]: F.lit(0.0)} | none)
    shared = shared or docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rate double")
    def best(texts: pd.Series) -> pd.DataFrame:
        bits = code_lengths(texts.tolist(), shared.value)
        least = bits.min(axis=1, keepdims=True)
        names = np.array(shared.value.languages, object)[bits.argmin(axis=1)]
        size = np.array([max(1, len(t.encode("utf-8", "surrogatepass"))) if t else 1 for t in texts])
        return pd.DataFrame({"lang": names, "score": 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1), "rate": least[:, 0] / size})

    has_letter = F.coalesce(body.rlike(LETTER), F.lit(False))
    found = docs.withColumns({"__found": best(body), "__letter": has_letter})
    more = {rate: F.when(F.col("__letter"), F.col("__found.rate"))} if rate else {}
    return found.withColumns(more | {
        into[0]: F.when(F.col("__letter"), F.col("__found.lang")).otherwise(UNDETERMINED),
        into[1]: F.when(F.col("__letter"), F.col("__found.score")).otherwise(0.0)}).drop("__found", "__letter")


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 1 modulo 3. Null keys are not held out."""
    k = F.col(f"`{key}`") if isinstance(key, str) else key
    return F.coalesce(F.crc32(k.cast("string").cast("binary")) % 3 == 1, F.lit(False))

"""Benchmark decontamination: a prefix-filtered set join between document and benchmark windows.

Every item gives windows of ``window`` words (a shorter item is one window). A window is a set of tokens:
its shingles of SHINGLE words (all its words if it has fewer). A document contains a window only if it
contains all of its tokens, so for full containment one token of each window is a sufficient prefix. Tokens
are ordered by rarity, counted over all documents, and the rarest one is the window's prefix:

1. documents are scanned for the items' tokens and those are counted (partial counts leave the tasks);
2. documents are scanned for prefix tokens only; an occurrence carries the words around it;
3. occurrences and windows are joined on the token; position and length bounds drop windows that would begin
   before the document or end behind it, and the words themselves are compared.

Scans look tokens up in a bitmap of fixed size before anything is written. A false hit of the bitmap or of a
token's hash only costs a row that the join drops, so no list has to fit into a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.sinks import materialise

SHINGLE = 3
BITMAP = 23
BLOCK = 4 << 20
TOGETHER = 4096
SPACE = 32
# Bytes to lower-cased word bytes; what is no ASCII letter or digit and below 0x80 separates words.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE for b in range(256)], np.uint8)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class Words:
    """The words of a block of texts: byte ranges in ``data``, and the first word of each text in ``bounds``."""

    def __init__(self, texts: list[bytes]):
        joined = b" " * 8 + b" ".join(texts) + b" " * 8
        self.data = data = BYTES[np.frombuffer(joined, np.uint8)]
        edge = np.diff((data != SPACE).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        begins = np.cumsum([8, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, begins)

    def slice(self, first: int, end: int) -> list[str]:
        """Words number first to end - 1."""
        return [w for w in self.data[self.starts[first]:self.ends[end - 1]].tobytes().decode("utf-8", "replace").split(" ") if w]

    def tokens(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles of ``size`` words that lie in one text, and the number of their first word."""
        data, n = self.data, self.ends - self.starts
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        first = eight[self.starts] & MASKS[np.minimum(n, 8)]
        last = np.where(n < 8, np.uint64(0), eight[self.ends - 8])
        word = (first ^ (last * MIX[0]) ^ n.astype(np.uint64)) * MIX[1]
        word ^= word >> np.uint64(31)
        after = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = np.flatnonzero(np.arange(size, len(word) + size) <= after)
        token = np.full(len(at), np.uint64(size))
        for k in range(size):
            token = (token ^ word[at + k]) * MIX[2]
            token ^= token >> np.uint64(29)
        return token * MIX[3], at


def _blocks(texts: list[str | None]):
    """(number of the first text, words) for blocks of texts."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.encode("utf-8", "replace") if t else b"")
        size += len(held[-1])
        if size >= BLOCK or i == len(texts) - 1:
            yield first, Words(held)
            held, size, first = [], 0, i + 1


def _slot(token: np.ndarray) -> np.ndarray:
    return token >> np.uint64(64 - BITMAP)


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """Bits of the tokens' first BITMAP bits; at most 2^(BITMAP - 6) rows reach the driver."""
    slot = F.shiftrightunsigned("token", 64 - BITMAP)
    found = tokens.groupBy((slot / 64).cast("bigint").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(token, {64 - BITMAP}), 64) as int))")).alias("bits"))
    words = np.zeros(1 << BITMAP - 6, np.uint64)
    for r in found.collect():
        words[r.word] = np.uint64(r.bits & (1 << 64) - 1)
    return words.view(np.uint8)


def _hits(words: Words, sizes: list[int], bitmap: np.ndarray):
    for size in sizes:
        token, at = words.tokens(size)
        slot = _slot(token)
        keep = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        yield size, token[keep], at[keep]


def windows_of(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """``item_id, words, tokens, size`` for every window of every item."""
    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for first, words in _blocks(batch.column(1).to_pylist()):
                for i in range(len(words.bounds) - 1):
                    lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
                    if lo == hi:
                        continue
                    length = min(window, hi - lo)
                    size = min(SHINGLE, length)
                    token, at = words.tokens(size)
                    token = token.view(np.int64)[np.searchsorted(at, lo):np.searchsorted(at, hi)].tolist()
                    all_words = words.slice(lo, hi)
                    out += [(ids[first + i].as_py(), all_words[s:s + length], token[s:s + length - size + 1], size) for s in range(hi - lo - length + 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], ids.type), pa.array([r[1] for r in out], pa.list_(pa.string())),
                pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.int32())], names=["item_id", "words", "tokens", "size"])

    source = items.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"item_id {kind}, words array<string>, tokens array<bigint>, size int")


def _count(docs: DataFrame, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            for _, words in _blocks(batch.column(0).to_pylist()):
                for _, token, _ in _hits(words, sizes, shared.value):
                    token, n = np.unique(token, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _occurrences(docs: DataFrame, sizes: list[int], bitmap: np.ndarray, window: int) -> DataFrame:
    """A row per document (``row, doc, hash, n_words``) and a row per prefix token found (``row, n_words, token, at,
    begin, around``: its position, and the words around it). Those of a document of common words are many, but no
    row grows with the document."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["row", "doc", "hash", "n_words", "token", "at", "begin", "around"]

    def run(batches):
        for batch in batches:
            rows, counts = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for first, words in _blocks(batch.column(3).to_pylist()):
                size_of = np.diff(words.bounds)
                counts[first:first + len(size_of)] = size_of
                for _, token, at in _hits(words, sizes, shared.value):
                    for part in range(0, len(at), TOGETHER):
                        where = at[part:part + TOGETHER]
                        text = np.searchsorted(words.bounds, where, side="right") - 1
                        low, high = words.bounds[text], words.bounds[text + 1]
                        begin = np.maximum(low, where - window + 1)
                        around = [words.slice(x, y) for x, y in zip(begin.tolist(), np.minimum(high, where + window).tolist())]
                        n = len(where)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(rows[first + text]), pa.nulls(n, batch.column(1).type), pa.nulls(n, pa.int64()), pa.array(size_of[text]),
                            pa.array(token.view(np.int64)[part:part + TOGETHER]), pa.array((where - low).astype(np.int64)),
                            pa.array((begin - low).astype(np.int64)), pa.array(around, pa.list_(pa.string()))], names=names)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.list_(pa.string()))], names=names)

    return docs.select("row", "doc", "hash", "text").mapInArrow(
        run, f"row bigint, doc {kind}, hash bigint, n_words bigint, token bigint, at bigint, begin bigint, around array<string>")


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13) -> tuple[DataFrame, DataFrame]:
    """All documents as ``row, doc, hash, n_words`` and all windows found as ``row, start, end, item_id``."""
    body = F.col(f"`{text}`").cast("string")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc"), F.xxhash64(body).alias("hash"), body.alias("text"))
    windows = materialise(windows_of(items, item, item_text, window).withColumn("id", F.monotonically_increasing_id()), "windows")
    sizes = [r[0] for r in windows.select("size").distinct().orderBy("size").collect()]
    tokens = windows.select("id", F.posexplode("tokens").alias("offset", "token"))
    seen = materialise(_count(source, sizes, _bitmap(tokens)), "token-counts")
    ranked = tokens.join(seen, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("p"))
    prefix = materialise(windows.join(ranked, "id").select("item_id", "words", F.size("words").alias("length"), "p.token", "p.offset"), "prefixes")
    rows = materialise(_occurrences(source, sizes, _bitmap(prefix.select("token")), window), "occurrences")
    found = rows.filter("around is not null").select("row", "n_words", "token", "at", "begin", "around")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))  # position and length bounds
    same = F.slice("around", (F.greatest(start - F.col("begin"), F.lit(0)) + 1).cast("int"), F.col("length")) == F.col("words")
    hits = found.join(prefix, (found.token == prefix.token) & fits & same)
    return rows.filter("around is null").select("row", "doc", "hash", "n_words"), hits.select("row", start.alias("start"), (start + F.col("length")).alias("end"), "item_id")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """``key, hash, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs``.

    A word is hit if it lies in an occurrence of a window; ``contaminated`` if some are hit and they are at
    least a twentieth of the words. ``items`` holds the ids of items with occurring windows, sorted as text.
    Null and wordless texts have no words and no windows. Items without id hit words but have no id to
    report; repeated items count once. Repeated documents are judged one by one. ``hash`` is the text's hash. A very
    long text is scanned as a whole, and what is found in it is a row each. An empty table of documents gives no
    rows, one of items no hits; further columns are not looked at.
    """
    rows, hits = overlaps(docs, items, key, text, item, item_text, window)
    hits = materialise(hits, "hits")
    reach = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(reach, F.lit(0))), F.lit(0))
    words = hits.select("row", "start", "end").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    ids = hits.select("row", F.col("item_id").cast("string").alias("i")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("i")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.join(words, "row", "left").join(ids, "row", "left").select(
        F.col("doc").alias(key), "hash", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))

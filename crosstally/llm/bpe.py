"""Byte-level BPE encoding and decoding with the vocabulary and merges of a public tokenizer.

A text is split at added tokens, then by the tokenizer's pattern; the bytes of each piece are symbols of a doubly
linked list, the possible merges of neighbours wait in a priority queue by rank, then place. The smallest is
taken; an entry whose symbols have changed meanwhile is stale and skipped; a merge links the neighbours and adds
their new pairs. Decoding concatenates the tokens' bytes.

Texts are encoded in the tasks, row by row; nothing is shuffled. The tokenizer's file (a fixed size) is read on the
driver and goes to the tasks as a broadcast. The pieces met last are remembered by each worker, up to twice a
fixed number. Long texts are taken in segments, cut where the pattern always ends a piece.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts of ASCII characters.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
# The same for texts of Latin letters: characters up to U+024F, where all from U+00C0 on but two are letters.
LATIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+| ?[^\t-\r \x85\xa0A-Za-z0-9ªµº²³¹¼-¾À-ÖØ-öø-ɏ]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"""
SEGMENT = 1 << 18
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies: itself if it can be printed, else the next
    unused one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in printed else next(other)) for b in range(256)]


class Tokenizer:
    def __init__(self, content: str):
        told = json.loads(content)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocabulary = told["model"]["vocab"]
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, i in (vocabulary | added).items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.numbers = list(map(str, range(len(self.bytes_of))))
        self.first = [vocabulary[c] for c in letters]
        # By rank: what two symbols become; by left symbol: how to get the rank with a right one.
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.merged = [vocabulary[a + b] for a, b in pairs]
        ranks: list[dict[int, int]] = [{} for _ in self.bytes_of]
        for r, (a, b) in enumerate(pairs):
            ranks[vocabulary[a]][vocabulary[b]] = r
        self.rank = [held.get for held in ranks]
        # Of two bytes (the first one's eight bits in front): the rank, -1 for none.
        self.first_rank = [self.rank[a](b, -1) for a in self.first for b in self.first]
        self.added = added
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.any_pieces, self.ascii_pieces = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.latin_pieces, self.beyond_latin = re.compile(LATIN_PATTERN).findall, re.compile(r"[^\x00-\u024f]").search
        self.cut = regex.compile(r"(?<=\S)(?=\s)")
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        n, first, first_rank = len(piece), self.first, self.first_rank
        # By place: the rank of the symbol and its next one. A queue entry is one number: rank times n, plus place.
        current = [first_rank[a << 8 | b] for a, b in zip(piece, piece[1:])]
        queue = [r * n + i for i, r in enumerate(current) if r >= 0]
        symbols = [first[b] for b in piece]
        if not queue:
            return tuple(symbols)
        rank, merged, pop, push = self.rank, self.merged, heapq.heappop, heapq.heappush
        heapq.heapify(queue)
        current.append(-1)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            r = entry // n
            i = entry - r * n
            if current[i] != r:
                continue  # stale: one of the two is part of another merge by now
            j = after[i]
            k = after[i] = after[j]
            new = symbols[i] = merged[r]
            symbols[j] = current[j] = current[i] = -1
            if k < n:
                before[k] = i
                if (r := rank[new](symbols[k], -1)) >= 0:
                    current[i] = r
                    push(queue, r * n + i)
            h = before[i]
            if h >= 0:
                r = current[h] = rank[symbols[h]](new, -1)
                if r >= 0:
                    push(queue, r * n + h)
        return tuple([s for s in symbols if s >= 0])

    def pieces(self, text: str) -> list[str]:
        return self.ascii_pieces(text) if text.isascii() else self.any_pieces(text) if self.beyond_latin(text) else self.latin_pieces(text)

    def _remember(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that is not among the last REMEMBERED new ones: one of those before them, or merged."""
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        ids = self.known[piece] = self.older.get(piece) or self.merge(piece.encode("utf-8", "replace"))
        return ids

    def _plain(self, text: str):
        """Ids of a text without added tokens, a list per segment."""
        remember, at = self._remember, 0
        while at < len(text):
            end = at + SEGMENT
            found = self.cut.search(text, end) if end < len(text) else None
            end = found.start() if found else len(text)
            known = self.known.get
            yield list(chain.from_iterable([known(p) or remember(p) for p in self.pieces(text[at:end])]))
            at = end

    def segments(self, text: str | None):
        """Ids of a text, a list per segment. Null is empty."""
        text, at = text or "", 0
        for m in self.added_pattern.finditer(text) if self.added_pattern else ():
            yield from self._plain(text[at:m.start()])
            yield [self.added[m[0]]]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.segments(text)))

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from them."""
        n, joined, decoded, reader = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for ids in self.segments(text):
            if not ids:
                continue
            pick = itemgetter(*ids, ids[0])  # of one item it would give no tuple, so the first comes again
            joined.update((("," if n else "") + ",".join(pick(self.numbers)[:-1])).encode())
            decoded.update(reader.decode(b"".join(pick(self.bytes_of)[:-1])).encode())
            n += len(ids)
        decoded.update(reader.decode(b"", True).encode())
        return n, joined.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def tokenizer(content: str) -> Tokenizer:
    """One tokenizer for all tasks of a worker."""
    return Tokenizer(content)


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def with_ids(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of every text as an array of ints; null and empty texts have none."""
    shared = _shared(docs, path)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(tokenizer(shared.value).encode)

    return docs.withColumn(into, encode(F.col(f"`{text}`").cast("string")))


def with_text(rows: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text of an array of ids; null and empty arrays give an empty text."""
    shared = _shared(rows, path)

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        own = tokenizer(shared.value)
        return lists.map(lambda x: "" if x is None else own.decode(x))

    return rows.withColumn(into, decode(F.col(f"`{ids}`")))


def with_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens, ids_sha256, decoded_sha256`` of every whole text (null: empty). Every row is encoded by
    itself: repeated rows get the same answer and keys are not looked at."""
    shared = _shared(docs, path)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(tokenizer(shared.value).digests, texts)), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    out = docs.withColumn("__digest", digest(F.col(f"`{text}`").cast("string")))
    return out.withColumns({n: F.col(f"__digest.{n}") for n in names}).drop("__digest")

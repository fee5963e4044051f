"""Stretches of periodically repeated words, by a suffix automaton with link-cut access.

The suffix automaton of a word sequence has a tree of suffix links in which the path from a prefix's state to the
root holds all suffixes of that prefix. Every path segment has a colour: the place where its words ended last. The
words are taken in order; each one *accesses* its path as link-cut trees do (splay trees over preferred paths): the
segments met on the way give the previous ends of ever shorter suffixes, then the whole path takes the new end's
colour. A segment whose deepest state has length L and whose colour lies d words back says that the last L words
stood d words earlier, and that no longer suffix did. If d <= L that is a square of period d, d is the smallest
period, and the stretch with that period begins L + d words back. It is extended to the right word by word, once.
There are O(n log n) colour changes over a text of n words.

Texts are taken in the tasks, row by row; nothing is shuffled. The automaton is built only over words that can lie in
a run: inside a run every group of three words occurs again in that run, so words of groups that occur once
in their stretch end the stretch. This is counted for a block of texts at once, in buckets (two groups in one bucket
let words stay, never go), again and again while it rules out words. Memory is some 100 bytes for each word of the
longest stretch; of a text without repeats nothing is kept.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORDS_AT_ONCE = 1 << 19
# A run of q words a period has max(6, 4 q) words or more: any group of three of them occurs twice in it.
GROUP = 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def automaton(ids: list[int]) -> tuple[array, array, array]:
    """Suffix links and lengths of the states, and the state of each prefix. The first transition of a state is
    held in two arrays, further ones in a dictionary."""
    n = len(ids)
    room = 2 * n + 2
    link, length, first, to = (array("i", [-1]) * room for _ in range(4))
    length[0] = 0
    more: dict[int, dict[int, int]] = {}
    ends = array("i", [0]) * n
    last, states = 0, 1
    for i, word in enumerate(ids):
        new, p, q = states, last, -1
        states += 1
        length[new] = i + 1
        while p >= 0:
            if first[p] == word:
                q = to[p]
                break
            if first[p] < 0:
                first[p], to[p] = word, new
            elif (others := more.get(p)) is None:
                more[p] = {word: new}
            elif (found := others.get(word)) is None:
                others[word] = new
            else:
                q = found
                break
            p = link[p]
        if p < 0:
            link[new] = 0
        elif length[q] == length[p] + 1:
            link[new] = q
        else:
            copy = states
            states += 1
            length[copy], link[copy], first[copy], to[copy] = length[p] + 1, link[q], first[q], to[q]
            if q in more:
                more[copy] = dict(more[q])
            while p >= 0:
                if first[p] == word:
                    if to[p] != q:
                        break
                    to[p] = copy
                else:
                    others = more.get(p)
                    if others is None or others.get(word) != q:
                        break
                    others[word] = copy
                p = link[p]
            link[q] = link[new] = copy
        ends[i] = last = new
    return link[:states], length[:states], ends


class Accesses:
    """Link-cut access over a fixed tree. Each auxiliary (splay) tree is a path segment of one colour, which its
    root carries; ``up`` holds parents inside auxiliary trees and, at their roots, the parent of the segment."""

    def __init__(self, parent: array):
        n = len(parent)
        self.up, self.high, self.deep = array("i", parent), array("i", [-1]) * n, array("i", [-1]) * n
        self.colour = array("i", [-1]) * n

    def splay(self, x: int) -> None:
        up, high, deep, colour = self.up, self.high, self.deep, self.colour
        while True:
            y = up[x]
            if y < 0 or (high[y] != x and deep[y] != x):
                return
            z = up[y]
            if z >= 0 and (high[z] == y or deep[z] == y):
                turns = (y, x) if (high[z] == y) == (high[y] == x) else (x, x)
            else:
                turns = (x,)
            for c in turns:
                p = up[c]
                g = up[p]
                if high[p] == c:
                    inner = high[p] = deep[c]
                    deep[c] = p
                else:
                    inner = deep[p] = high[c]
                    high[c] = p
                if inner >= 0:
                    up[inner] = p
                if g >= 0 and high[g] == p:
                    high[g] = c
                elif g >= 0 and deep[g] == p:
                    deep[g] = c
                else:
                    colour[c] = colour[p]
                up[c], up[p] = g, c

    def access(self, x: int, new: int):
        """Gives the path from x to the root the colour ``new``. Returns the deepest node and the former colour of
        each segment on it, longest suffix first."""
        up, deep, colour, met = self.up, self.deep, self.colour, []
        v, below = x, -1
        while v >= 0:
            self.splay(v)
            met.append((v, colour[v]))
            cut = deep[v]
            if cut >= 0:
                colour[cut] = colour[v]
            deep[v] = below
            below, v = v, up[v]
        colour[below] = new
        self.splay(x)
        return met


def runs_of(ids: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the maximal stretches with smallest period q and length at least
    ``max(least, exponent * q)``; exponent is 2 at least."""
    n, found, until = len(ids), [], {}
    link, length, ends = automaton(ids)
    paths = Accesses(link)
    for i in range(n):
        for v, before in paths.access(ends[i], i):
            period = i - before
            if before < 0 or period > length[v] or until.get(period, -1) >= i:
                continue
            start, end = i - length[v] - period + 1, i + 1
            while end < n and ids[end] == ids[end - period]:
                end += 1
            until[period] = end - 1
            if end - start >= max(least, exponent * period):
                found.append((start, end - start, period))
    return found


def stretches(ids: np.ndarray, ends: np.ndarray, least: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in the words of a block of texts that end at ``ends``, of all stretches that can hold runs
    of ``least`` words or more that repeat four times or more."""
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= least
    begins, ends, words = begins[long], ends[long], 2 * len(ids) + 1
    while len(begins) and (now := int((ends - begins).sum())) < 0.9 * words:
        words, lengths = now, ends - begins
        first = np.cumsum(lengths) - lengths
        at = np.arange(words) + np.repeat(begins - first, lengths)
        key = np.repeat(np.arange(len(begins), dtype=np.uint64), lengths)
        for k in range(GROUP):
            key = (key ^ ids[np.minimum(at + k, len(ids) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        bucket = (key & np.uint64((1 << words.bit_length() + 2) - 1)).astype(np.int64)
        # The last words of a stretch begin no whole group, so no chain of groups goes on into the next stretch.
        whole = at + GROUP <= np.repeat(ends, lengths)
        again = np.zeros(words + 2, np.int8)
        again[1:-1] = whole & (np.bincount(bucket[whole], minlength=int(bucket.max()) + 1)[bucket] > 1)
        step = np.diff(again)
        begin, end = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
        enough = end - begin >= least - GROUP + 1
        begins, ends = at[begin[enough]], at[end[enough] - 1] + GROUP
    return begins, ends


def repeated(texts: list[str | None], least: int, exponent: int) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """The runs of each text, by start, then period, and the text without what they repeat."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    ends = np.cumsum([len(w) for w in words])
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.uint64, int(ends[-1]) if len(words) else 0)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for begin, end in zip(*map(np.ndarray.tolist, stretches(ids, ends, least))):
        text = int(np.searchsorted(ends, begin, "right"))
        offset = begin - (int(ends[text - 1]) if text else 0)
        found[text] += [(s + offset, n, q) for s, n, q in runs_of(ids[begin:end].tolist(), least, exponent)]
    kept = []
    for own, runs in zip(words, found):
        runs.sort(key=lambda r: (r[0], r[2]))
        if runs:
            stay = np.ones(len(own), bool)
            for start, n, q in runs:
                stay[start + q:start + n] = False
            own = [own[i] for i in np.flatnonzero(stay).tolist()]
        kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
    return found, kept


def with_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """The ``keep`` columns of every row, its ``runs`` (start in words from 0, length, period) and
    its text ``collapsed`` to the words that no run repeats (words inside a run behind its first period go).

    A run is a maximal stretch of words with smallest period q and a length of at least ``max(least, exponent * q)``
    (exponent: 4 at least; least: 6 at least). Null, empty and blank texts have no words and no runs. Every row is
    taken by itself: repeated rows get the same answer, keys are not looked at and may be null or tied. A long text
    is taken whole in one task. Other columns are ignored, whatever their names.
    """
    if exponent < 4 or least < 6:
        raise ValueError("exponent must be 4 at least, least 6")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            texts, at = batch.column(len(keep)).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 8 * WORDS_AT_ONCE:
                    size += len(texts[end] or "")
                    end += 1
                part = batch.slice(at, end - at)
                found, kept = repeated(texts[at:end], least, exponent)
                flat = [r for runs in found for r in runs]
                fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], runs, pa.array(kept, pa.string())], names=[*keep, "runs", "collapsed"])
                at = end

    kept_columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept_columns}, runs {RUNS}, collapsed string")

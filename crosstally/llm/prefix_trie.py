"""Trie of conversation prefixes by a splitter skeleton.

A conversation is the path of its turns' 128-bit digests. Equal paths are one row (with their number, their smallest
conversation and the digest of all their ids, read as a sorted stream). The distinct paths are dealt to shards by
range: the splitters are quantiles of a bounded sample, at most ``deepest`` turns long each. A node whose members lie
in two shards is a prefix of the splitter between them. So the trie of all splitter paths, the *skeleton*, holds every
node that needs more than one shard. It has at most ``MOST_SHARDS * deepest`` nodes and is broadcast. Every shard
sorts its paths and walks them with a stack: nodes outside the skeleton are finished there, skeleton nodes leave
partial figures, which are combined by sums and minima. What skeleton nodes add to their ancestors is summed likewise.

A node with very many members or children is a skeleton node and is spread over shards. A conversation is one row
of some 20 bytes a turn; its texts do not travel.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import materialise

DIGEST = 16
MOST_SHARDS = 4096
SAMPLED = 8
IDS_AT_ONCE = 512
FIGURES = ("conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
FOUND = pa.schema([("skeleton", pa.int32()), ("parent", pa.int32()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("depth", pa.int64()), ("bytes", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
COLUMNS = "skeleton int, parent int, conv_id bigint, parent_conv_id bigint, depth bigint, bytes bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as structs of ``digest`` (of role and text) and
    ``bytes`` (of the text). Null roles and texts are empty; null turns come first, equal turns by digest."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = conversations.filter("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.digest.alias("digest"), t.bytes.alias("bytes")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _ends(rows: DataFrame) -> DataFrame:
    """``path_id, n, least, ends_sha256`` of ``path_id, conv_id``: ids of equal paths are joined piece by piece where
    they lie sorted, and only the pieces of a path meet, one after the other."""
    def pieces(batches):
        last, ids = None, []
        for batch in batches:
            done = []
            for path, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (path != last or len(ids) == IDS_AT_ONCE):
                    done.append((last, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                last = path
                ids.append(conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path_id", "first", "n", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (last, ids[0], len(ids), ",".join(map(str, ids)))], names=["path_id", "first", "n", "ids"])

    def digests(batches):
        last, least, n, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            done = []
            for path, first, more, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if path != last:
                    if n:
                        done.append((last, n, least, digest.hexdigest()))
                    last, least, n, digest = path, first, 0, hashlib.sha256()
                digest.update(("," if n else "").encode() + ids.encode())
                n += more
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path_id", "n", "least", "ends_sha256"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (last, n, least, digest.hexdigest())], names=["path_id", "n", "least", "ends_sha256"])

    by_id = rows.select("path_id", "conv_id").repartitionByRange("path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
    parts = by_id.mapInArrow(pieces, "path_id string, first bigint, n bigint, ids string")
    return parts.repartition("path_id").sortWithinPartitions("path_id", "first").mapInArrow(digests, "path_id string, n bigint, least bigint, ends_sha256 string")


def splitters_of(paths: DataFrame, shards: int, deepest: int) -> list[bytes]:
    """At most ``shards - 1`` paths, cut to ``deepest`` turns, that cut the distinct ``paths`` into ranges of about
    the same number, by a sample of some ``SAMPLED`` paths a shard, drawn by hash."""
    total = paths.count()
    drawn = paths.filter(F.pmod(F.xxhash64("path"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLED * shards / max(total, 1))))
    sample = sorted(bytes(r[0]) for r in drawn.select(F.substring("path", 1, deepest * DIGEST)).collect())
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)} - {b""}) if sample else []


def skeleton_of(splitters: list[bytes]) -> tuple[dict[tuple[int, bytes], int], list[int]]:
    """The trie of the splitter paths: (parent's number, digest) -> number, and each node's parent. The root is 0."""
    child, parents = {}, [-1]
    for path in splitters:
        at = 0
        for k in range(0, len(path), DIGEST):
            step = (at, path[k:k + DIGEST])
            if step not in child:
                child[step] = len(parents)
                parents.append(at)
            at = child[step]
    return child, parents


def common(a: bytes, b: bytes) -> int:
    """Number of turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // DIGEST + 1
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGEST:mid * DIGEST] == b[low * DIGEST:mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("skeleton", "depth", "bytes", "least", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int, depth: int, size: int):
        self.skeleton, self.depth, self.bytes = skeleton, depth, size
        self.least, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None
        self.waiting: list[list] = []  # rows of children that want this node's smallest member


def _closed(node: _Node, parent: _Node | None) -> list[list]:
    """Adds a node's figures to its parent's. Returns the rows that are final by now."""
    done = []
    inside = node.skeleton >= 0
    if not inside:
        node.saved += (node.n - 1) * node.bytes
        node.leaves = node.leaves or 1
        for row in node.waiting:
            row[3] = node.least
        done = node.waiting
    row = [node.skeleton if inside else None, None, node.least, None, node.depth, node.bytes, node.n, node.children, node.leaves, node.saved, node.ends]
    if parent is not None:
        parent.least = node.least if parent.least is None else min(parent.least, node.least)
        parent.n += node.n
        parent.leaves += node.leaves
        parent.saved += node.saved
        parent.children += not inside
    if inside:
        return [row]
    if parent.skeleton < 0:
        parent.waiting.append(row)
        return done
    row[1] = parent.skeleton
    return [*done, row]


def walk(rows, child: dict[tuple[int, bytes], int]):
    """Final rows and skeleton partials of one shard's ``(path, bytes of the turns, n, least, ends_sha256)``, sorted
    by path."""
    stack, before = [_Node(0, 0, 0)], b""
    for path, sizes, n, least, ends in rows:
        keep = common(before, path)
        while len(stack) > keep + 1:
            yield from _closed(stack.pop(), stack[-1])
        for k in range(keep, len(path) // DIGEST):
            at = stack[-1].skeleton
            skeleton = child.get((at, path[k * DIGEST:(k + 1) * DIGEST]), -1) if at >= 0 else -1
            stack.append(_Node(skeleton, k + 1, sizes[k]))
        top = stack[-1]
        top.n, top.ends, before = top.n + n, ends, path
        top.least = least if top.least is None else min(top.least, least)
    while stack:
        yield from _closed(stack.pop(), stack[-1] if stack else None)


def nodes(conversations: DataFrame, turns_per_shard: int = 1 << 14, deepest: int = 32) -> DataFrame:
    """One row per node of the trie of ``conversations`` (``conv_id, turns``, see :func:`turn_lists`): ``conv_id``
    (smallest member: the node is the first ``depth`` turns of it), ``parent_conv_id`` (the parent's; null for the
    root), ``depth``, ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in the subtree),
    ``saved_tokens`` (over the subtree: bytes of the last text of all members but one), ``ends_sha256`` (of the sorted,
    comma-joined ids of the conversations that end here).

    ``conv_id`` must be unique, as it is after :func:`turn_lists`; conversations without turns are members of the
    root. No conversations, no nodes. Other columns are ignored. ``turns_per_shard`` sets the number of shards, at
    most ``MOST_SHARDS``; ``deepest`` bounds the skeleton, not the result: paths that first differ behind it share a
    shard.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    rows = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.bytes).alias("sizes"))
    rows = materialise(rows.withColumn("path_id", F.substring(F.sha2("path", 256), 1, 2 * DIGEST)), "paths")
    groups = materialise(_ends(rows), "equal-paths")
    paths = rows.select(F.col("conv_id").alias("least"), "path", "sizes").join(groups.drop("path_id"), "least")
    paths = materialise(paths, "distinct-paths")
    turns = paths.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    shards = min(MOST_SHARDS, 1 + turns // turns_per_shard)
    splitters = splitters_of(paths, shards, deepest)
    child, parents = skeleton_of(splitters)
    spark = conversations.sparkSession
    shared = spark.sparkContext.broadcast((splitters, child))

    def deal(batches):
        for batch in batches:
            shard = [bisect_right(shared.value[0], p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    def finish(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found = chain.from_iterable(walk((r[1:] for r in own), shared.value[1]) for _, own in groupby(rows, itemgetter(0)))
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), FOUND)], schema=FOUND)

    dealt = paths.select("path", "sizes", "n", "least", "ends_sha256").mapInArrow(deal, "shard int, path binary, sizes array<bigint>, n bigint, least bigint, ends_sha256 string")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path")
    found = materialise(dealt.mapInArrow(finish, COLUMNS), "trie-shards")
    return _joined(found, parents)


def _joined(found: DataFrame, parents: list[int]) -> DataFrame:
    """All nodes, from the shards' rows and the skeleton's partials. ``parents`` is of the skeleton's bounded size."""
    lines = []
    for k, above in enumerate(parents):
        line, at = [k], above
        while at >= 0:
            line.append(at)
            at = parents[at]
        lines.append((k, above, line))
    lines = found.sparkSession.createDataFrame(lines, "node int, above int, line array<int>")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    part = found.filter("skeleton is not null").groupBy(F.col("skeleton").alias("node")).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.max("ends_sha256").alias("ends_sha256"), *sums)
    part = materialise(part.join(lines, "node"), "skeleton")
    inner = part.groupBy(F.col("above").alias("node")).agg(F.count("*").alias("more"))
    part = part.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    added = part.select(F.explode("line").alias("node"), (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    added = added.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    above = materialise(part.select(F.col("node").alias("above"), F.col("conv_id").alias("of_parent")), "skeleton-members")
    skeleton = part.join(added, "node").join(above, "above", "left").withColumns({
        "n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("own"), "parent_conv_id": F.col("of_parent")}).select(*FIGURES)
    rest = found.filter("skeleton is null").join(F.broadcast(above), F.col("parent") == F.col("above"), "left")
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_parent")).select(*FIGURES)
    return rest.union(skeleton).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def with_shared_heads(conversations: DataFrame, every: int, head: Column, most: int) -> DataFrame:
    """Each conversation with its first ``head`` turns (``most`` at most) replaced by those of the conversation whose
    id is the next lower multiple of ``every`` (none if there is no such one)."""
    heads = conversations.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, most).alias("first"))
    joined = conversations.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("of"), "left").withColumn("head", head)
    own = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))
    turns = F.when(F.col("of").isNull(), own).otherwise(F.concat(F.slice("first", F.lit(1), F.col("head")), own))
    return joined.select("conv_id", turns.alias("turns"))

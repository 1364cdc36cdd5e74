"""Prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

A conversation is a path: a digest of each turn, in order.  Paths are dealt to ranges by (path, conv_id), so equal ones lie
side by side and may be split between ranges however many they are.  Inside a range the edges between neighbours, in descending
depth of their common prefix, join components: what lies between the old and the new depth of a component is a chain of nodes
with one child, and a merge of two components is a branching node.  Nodes that hold neither the first nor the last path of
their range are final.  The others, two chains a range, may go on in the ranges beside it: they travel as (prefix digest, counts
of what is final below) and are merged by prefix; what a merged node adds to the subtrees above it is summed by ancestor.

Memory is that of one range's paths (16 bytes a turn) and of its nodes.  What crosses ranges is two chains for each, of as many
nodes as a conversation has turns; a merged node is added to each of its ancestors, so a range costs at most depth² rows.
The ids that end at a node of several ranges are hashed as a stream in their order, in pieces of ``PIECE`` ids.

A null role or text is an empty one; turns of one number (or none, which come first) follow by digest, repeated rows count
each; rows without a conv_id belong to no conversation and are left out; an empty table has no nodes, not even a root; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.shared import staged

PIECE = 4096
_DIGEST = 16
_EMPTY = hashlib.sha256().hexdigest()
_KINDS = FINAL, OPEN, ENDS = 0, 1, 2
_PARTS = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("ancestors", pa.list_(pa.binary())),
])
_PARTS_DDL = "kind int, part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, key binary, parent_key binary, ancestors array<binary>"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: an array of (digest, words), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _DIGEST)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", digest.alias("digest"), word_count(text).alias("words")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


class Forest:
    """Nodes over sorted paths: a node is an interval [low, high] of paths that share their first ``depth`` turns."""

    def __init__(self, paths: list[bytes], words: list, ids: list[int]):
        self.paths, self.words, self.ids = paths, words, ids
        self.last = len(paths) - 1
        self.length = [len(p) // _DIGEST for p in paths]
        self.low, self.high, self.depth, self.least = list(range(len(paths))), list(range(len(paths))), list(self.length), list(ids)
        self.kids, self.leaves, self.saved = ([0] * len(paths) for _ in range(3))  # of final nodes below
        self.parent: list[int] = [-1] * len(paths)
        self.closed: list[int] = []
        self.build()

    def shared(self, a: int) -> int:
        """Turns that path a shares with the next."""
        x, y = self.paths[a], self.paths[a + 1]
        n = min(len(x), len(y))
        differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
        return (n - (differ.bit_length() + 7) // 8) // _DIGEST

    def size(self, v: int) -> int:
        return self.high[v] - self.low[v] + 1

    def own(self, v: int) -> int:
        return (self.size(v) - 1) * self.turn_words(v)

    def turn_words(self, v: int) -> int:
        return self.words[self.low[v]][self.depth[v] - 1] if self.depth[v] else 0

    def open(self, v: int) -> bool:
        return self.low[v] == 0 or self.high[v] == self.last

    def up(self, v: int, depth: int) -> int:
        """Close v and the chain above it, as far as a node at ``depth``."""
        while self.depth[v] > depth:
            p, final = len(self.depth), not self.open(v)
            self.closed.append(v)
            self.parent[v] = p
            self.low.append(self.low[v])
            self.high.append(self.high[v])
            self.depth.append(self.depth[v] - 1)
            self.least.append(self.least[v])
            self.kids.append(int(final))
            self.leaves.append(self.leaves[v] + int(final and not self.kids[v]))
            self.saved.append(self.saved[v] + (self.own(v) if final else 0))
            self.parent.append(-1)
            v = p
        return v

    def build(self) -> None:
        top = list(range(len(self.paths)))  # the component's node, at its root path
        root = list(range(len(self.paths)))
        self.alias: dict[int, int] = {}

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        depths = [self.shared(a) for a in range(self.last)]
        for a in np.argsort(-np.array(depths, np.int64), kind="stable").tolist():
            x, y = find(a), find(a + 1)
            v, w = self.up(top[x], depths[a]), self.up(top[y], depths[a])
            self.high[v] = self.high[w]
            self.least[v] = min(self.least[v], self.least[w])
            for values in (self.kids, self.leaves, self.saved):
                values[v] += values[w]
            self.alias[w] = v
            root[y], top[x] = x, v
        self.closed.append(self.up(top[find(0)], 0))

    def node(self, v: int) -> int:
        while v in self.alias:
            v = self.alias[v]
        return v

    def ending(self, v: int) -> list[int]:
        """Ids of the conversations that end at v: the shortest of its interval come first."""
        a = b = self.low[v]
        while b <= self.high[v] and self.length[b] == self.depth[v]:
            b += 1
        return self.ids[a:b]

    def key(self, v: int) -> bytes:
        return hashlib.sha256(self.paths[self.low[v]][: _DIGEST * self.depth[v]]).digest()

    def rows(self, part: int) -> Iterator[tuple]:
        """Rows of ``_PARTS``."""
        keys: dict[int, bytes] = {}  # of open nodes
        chains = {v: None for v in self.closed if self.open(v)}
        for v in chains:
            keys[v] = self.key(v)
        for v in self.closed:
            p, ends = self.node(self.parent[v]) if self.parent[v] >= 0 else -1, self.ending(v)
            if v in chains:
                above, at = [], p
                while at >= 0:
                    above.append(keys[at])
                    at = self.node(self.parent[at]) if self.parent[at] >= 0 else -1
                yield (OPEN, part, self.least[v], self.depth[v], None, self.size(v), self.kids[v], self.leaves[v], self.saved[v], self.turn_words(v), None, keys[v], above[0] if above else None, above)
                for low in range(0, len(ends), PIECE):
                    yield (ENDS, part, ends[low], None, None, None, None, None, None, None, ",".join(map(str, ends[low : low + PIECE])), keys[v], None, None)
            else:
                sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _EMPTY
                parent = (None, keys[p]) if p in chains else (self.least[p], None)
                yield (FINAL, part, self.least[v], self.depth[v], parent[0], self.size(v), self.kids[v], self.leaves[v] + int(not self.kids[v]), self.saved[v] + self.own(v), None, sha, None, parent[1], None)


def range_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of sorted paths."""
    paths, words, ids = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        paths += batch.column(1).to_pylist()
        words += batch.column(2).to_pylist()
    if not ids:
        return
    found = list(Forest(paths, words, ids).rows(TaskContext.get().partitionId()))
    for low in range(0, len(found), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[low : low + 20_000], strict=True), _PARTS, strict=True)], schema=_PARTS)


def hash_ends(pieces: DataFrame) -> DataFrame:
    """key and ends_sha256 of pieces (key, conv_id, ends): one stream for each key, in the order of ids."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(text.encode())
                else:
                    digest.update(f",{text}".encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.binary()), "ends_sha256": pa.array([x for _, x in done], pa.string())})
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()], pa.string())})

    return pieces.select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(stream, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``conv_id, turns`` (as of ``conversation_turns``): conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    paths = staged(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words")), "paths")
    ranges = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = staged(ranges.select("conv_id", "path", "words").mapInArrow(range_forests, _PARTS_DDL), "forests")
    # the chains of all ranges, merged by prefix
    chains = parts.where(F.col("kind") == OPEN)
    merged = staged(
        chains.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("ancestors").alias("ancestors"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"),
        ), "chains",
    )
    open_kids = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("open_kids"))
    nodes = merged.join(open_kids, "key", "left").withColumn("n_children", F.col("kids") + F.coalesce("open_kids", F.lit(0)))
    leaf, own = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    added = nodes.select(F.explode(F.array_append("ancestors", F.col("key"))).alias("key"), leaf.alias("l"), own.alias("s")).groupBy("key").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    ends = hash_ends(parts.where(F.col("kind") == ENDS))
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    shared = nodes.join(added, "key").join(ends, "key", "left").join(names, "parent_key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    final = parts.where(F.col("kind") == FINAL).withColumnRenamed("ends", "ends_sha256")
    # children of a chain's node meet its row of their own range, so that no node's children gather
    local = chains.select("part", F.col("key").alias("parent_key")).join(names, "parent_key")
    hanging = final.where("parent_key is not null").drop("parent_conv_id").join(local, ["part", "parent_key"])
    return shared.unionByName(final.where("parent_key is null").select(NODE)).unionByName(hanging.select(NODE))

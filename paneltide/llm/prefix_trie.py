"""The trie of common beginnings of conversations, finished in sorted shards around a skeleton of splitter paths.

A conversation is the sequence of its turns; a turn is known by 128 bits of the
SHA-256 of role and text.  The path of a conversation is its turns' hashes in
a row, so paths sort in trie order and a node's members are neighbours.  Paths
are dealt to shards by ranges of (path, conv_id), cut at splitters from a
sample.  A node whose members lie in two shards has a splitter between them and
is a prefix of it.  So the skeleton, the trie of the splitter paths, which is
broadcast, holds all nodes that shards share: every other node is finished by
one shard in one run over its sorted rows.  For skeleton nodes each shard sends one partial aggregate, which
sums reduce; one last task, which sees nothing but the skeleton, adds skeleton children
to their parents.  Copies of one conversation are cut by conv_id, so no group of
copies lands in one shard.

Node numbers: a skeleton node is (splitter, depth), the first splitter with this
prefix.  Texts are never shuffled, only 16 bytes and a word count a turn; the turns of one
conversation meet in one task, in that form.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Turns in a shard, about; rows of the sample for each shard.
SHARD, PER_SHARD = 100_000, 16
#: Bytes of ids of copies that go to the skeleton's hash in one row.
PIECE = 1 << 18
#: Skeleton nodes up to which they are broadcast to the shards' nodes; beyond, the join is left to Spark.
BROADCAST_NODES = 1_000_000
_H = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ("shared boolean, splitter int, depth int, conv_id long, parent_conv_id long, parent_splitter int, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, words long, ends_sha256 string, shard int, number int, ids string")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turns``: array of (has a number, turn, key, words) in order of turn (null first; equal ones by key).

    Null role or text is empty.  Rows of null conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _H)
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
                    F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def paths(seqs: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (hashes of the turns in a row), ``words`` (of each turn) from ``conv_id``, ``turns``."""
    return seqs.select("conv_id", F.unhex(F.array_join(F.col("turns.key"), "")).alias("path"), F.col("turns.words").alias("words"))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Paths of conversations that begin like their group's first one.

    Conversation c starts with the first h = crc32(c) % ``most`` turns of conversation c - c % ``group``
    (all if fewer, none if absent), then come its own turns after its first h.
    """
    own = stage(turns(conversations), "turns")
    head = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    seqs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(head, "base", "left").withColumn("h", h.cast("int"))
    first = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + F.lit(1), F.size("turns"))
    return paths(seqs.select("conv_id", F.concat(first, rest).alias("turns")))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    most = min(len(a), len(b)) // _H
    low = 0
    if a[:most * _H] == b[:most * _H]:
        return most
    while a[low * _H:low * _H + _H] == b[low * _H:low * _H + _H]:
        low += 1
    return low


class Skeleton:
    """The trie of the splitter paths: ``owner[k][d]`` is the first splitter with the first d turns of splitter k."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.keys = splitters
        self.owner: list[list[int]] = []
        for k, (path, _) in enumerate(splitters):
            shared = _common(path, splitters[k - 1][0]) if k else -1
            self.owner.append([self.owner[k - 1][d] if d <= shared else k for d in range(len(path) // _H + 1)])
        self.size = sum(len({(j, d) for d, j in enumerate(o) if j == k}) for k, o in enumerate(self.owner)) or 1

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.keys, (path, conv_id))

    def nodes(self, shard: int, path: bytes) -> list[int]:
        """Splitters of the skeleton nodes on a path of this shard, by depth, the root first."""
        best: list[int] = [0]
        for k in (shard - 1, shard):  # a prefix of any splitter is one of a neighbour
            if 0 <= k < len(self.keys):
                n = _common(path, self.keys[k][0]) + 1
                if n > len(best):
                    best = self.owner[k][:n]
        return best


def _route(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Skeleton(skeleton.value)
        for b in batches:
            shard = [trie.shard(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column("path"), b.column("conv_id"), b.column("words")], ["shard", "path", "conv_id", "words"])

    return run


class _Shard:
    """One run over the sorted rows of a shard: open nodes on a stack, closed ones in columns."""

    def __init__(self, trie: Skeleton, shard: int, schema: pa.Schema) -> None:
        self.trie, self.shard, self.schema = trie, shard, schema
        self.path, self.stack = b"", []
        # of each node: depth, splitter (-1: local), parent, smallest member, members, children, leaves, saved, words, hash
        self.depth, self.splitter, self.parent, self.low, self.n, self.children, self.leaves, self.saved, self.words, self.sha = ([] for _ in range(10))
        self.pieces: list[tuple[int, int, str]] = []
        self.hash = None
        self.ids: list[str] = []
        self.held = 0

    def _open(self, splitter: int, words: int, conv_id: int) -> None:
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.stack.append(len(self.depth))
        for column, value in zip((self.depth, self.splitter, self.low, self.n, self.children, self.leaves, self.saved, self.words, self.sha),
                                 (len(self.stack) - 1, splitter, conv_id, 0, 0, 0, 0, words, _EMPTY), strict=True):
            column.append(value)

    def _close(self) -> None:
        x = self.stack.pop()
        y = self.parent[x]
        if self.splitter[x] < 0:
            if not self.children[x]:
                self.leaves[x] = 1
            self.saved[x] += (self.n[x] - 1) * self.words[x]
            self.children[y] += 1
        if y >= 0:
            self.leaves[y] += self.leaves[x]
            self.saved[y] += self.saved[x]
            self.n[y] += self.n[x]
            if self.low[x] < self.low[y]:
                self.low[y] = self.low[x]

    def _end(self) -> None:
        """The ids of the conversations that end in the node on top are all there."""
        if self.hash is not None:
            self.sha[self.stack[-1]] = self.hash.hexdigest()
            self.hash = None
        if self.ids:
            self.pieces.append((self.splitter[self.stack[-1]], self.depth[self.stack[-1]], ",".join(self.ids)))
            self.ids, self.held = [], 0

    def add(self, path: bytes, conv_id: int, words: list[int]) -> None:
        if not self.stack or path != self.path:
            if self.stack:
                self._end()
                keep = _common(path, self.path) + 1
                while len(self.stack) > keep:
                    self._close()
            shared = self.trie.nodes(self.shard, path)
            for d in range(len(self.stack), len(path) // _H + 1):
                self._open(shared[d] if d < len(shared) else -1, words[d - 1] if d else 0, conv_id)
            self.path = path
        top = self.stack[-1]
        self.n[top] += 1
        if conv_id < self.low[top]:
            self.low[top] = conv_id
        if self.splitter[top] >= 0:
            self.ids.append(str(conv_id))
            self.held += 20
            if self.held >= PIECE:
                self.pieces.append((self.splitter[top], self.depth[top], ",".join(self.ids)))
                self.ids, self.held = [], 0
        elif self.hash is None:
            self.hash = hashlib.sha256(str(conv_id).encode())
        else:
            self.hash.update(f",{conv_id}".encode())

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.stack:
            self._end()
        while self.stack:
            self._close()
        size = 20_000
        for a in range(0, len(self.depth), size):
            rows = range(a, min(a + size, len(self.depth)))
            local = [self.splitter[x] < 0 for x in rows]
            up = [self.parent[x] for x in rows]
            inner = [mine and self.splitter[y] < 0 for mine, y in zip(local, up, strict=True)]
            yield self._batch({
                "shared": [not x for x in local], "splitter": [self.splitter[x] for x in rows], "depth": [self.depth[x] for x in rows], "conv_id": [self.low[x] for x in rows],
                "parent_conv_id": [self.low[y] if i else None for i, y in zip(inner, up, strict=True)],
                "parent_splitter": [self.splitter[y] if m and not i else None for m, i, y in zip(local, inner, up, strict=True)],
                "n_convs": [self.n[x] for x in rows], "n_children": [self.children[x] for x in rows], "n_leaves": [self.leaves[x] for x in rows], "saved_tokens": [self.saved[x] for x in rows],
                "words": [self.words[x] for x in rows], "ends_sha256": [self.sha[x] for x in rows]}, len(rows))
        for a in range(0, len(self.pieces), 64):
            part = self.pieces[a:a + 64]
            yield self._batch({"splitter": [p[0] for p in part], "depth": [p[1] for p in part], "shard": [self.shard] * len(part), "number": list(range(a, a + len(part))), "ids": [p[2] for p in part]}, len(part))

    def _batch(self, columns: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in self.schema], schema=self.schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ddl.split(", ")])


def _build(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema, now = Skeleton(skeleton.value), _schema(_NODE), None
        for b in batches:
            for shard, path, conv_id, words in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")), strict=True):
                if now is None or now.shard != shard:
                    if now is not None:
                        yield from now.finish()
                    now = _Shard(trie, shard, schema)
                now.add(path, conv_id, words)
        if now is not None:
            yield from now.finish()

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each skeleton node, from its pieces in order."""
    node, h = None, None
    out: list[tuple[int, int, str]] = []
    for b in batches:
        for j, d, ids in zip(*(b.column(c).to_pylist() for c in ("splitter", "depth", "ids")), strict=True):
            if (j, d) == node:
                h.update(b",")
            else:
                if node:
                    out.append((*node, h.hexdigest()))
                node, h = (j, d), hashlib.sha256()
            h.update(ids.encode())
    if node:
        out.append((*node, h.hexdigest()))
    columns = list(zip(*out, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["splitter", "depth", "ends"])


_SUMS = "splitter int, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _upwards(skeleton):
    """Skeleton children are added to their parents, the deepest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = Skeleton(skeleton.value).owner
        nodes = {(r["splitter"], r["depth"]): r for b in batches for r in b.to_pylist()}
        up = lambda j, d: (owner[j][d - 1] if owner else 0, d - 1)
        for j, d in nodes:
            if d:
                nodes[up(j, d)]["n_children"] += 1
        for (j, d), r in sorted(nodes.items(), key=lambda x: -x[0][1]):
            r["n_leaves"] += r.pop("more_leaves", 0) + (not r["n_children"])
            r["saved_tokens"] += r.pop("more_saved", 0) + (r["n_convs"] - 1) * r["words"]
            if d:  # shards have added the local part of a child already
                parent = nodes[up(j, d)]
                parent["more_leaves"] = parent.get("more_leaves", 0) + r["n_leaves"] - r["local_leaves"]
                parent["more_saved"] = parent.get("more_saved", 0) + r["saved_tokens"] - r["local_saved"]
                r["parent_conv_id"] = parent["conv_id"]
        schema = _schema(_SUMS)
        yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in nodes.values()], schema=schema)

    return run


def splitters(table: DataFrame, shards: int, convs: int) -> list[tuple[bytes, int]]:
    """``shards - 1`` keys that cut the sorted paths evenly, from a sample of about ``PER_SHARD`` rows a shard."""
    if shards < 2:
        return []
    every = max(1, convs // (PER_SHARD * shards))
    some = table.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("path", "conv_id")
    rank = some.withColumn("r", F.row_number().over(Window.orderBy("path", "conv_id"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    cut = rank.where(F.floor(F.col("r") * shards / F.col("n")) > F.floor((F.col("r") - 1) * shards / F.col("n"))).where("r < n")
    return sorted((bytes(r["path"]), r["conv_id"]) for r in cut.select("path", "conv_id").collect())


def prefix_trie(seqs: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``seqs`` (``conv_id``, ``path``, ``words``; conv_id is unique and not null).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (over the subtree, (n_convs - 1) times the words of a node's last turn),
    ends_sha256 (of the ids of the conversations that end there, ascending, joined by commas).
    Turnless conversations end at the root.  No conversations: no rows.
    """
    spark = seqs.sparkSession
    table = stage(seqs, "paths")
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words") + F.lit(1)), F.lit(0)).alias("turns")).first()
    shards = max(1, math.ceil(size["turns"] / shard_turns))
    keys = splitters(table, shards, size["n"])
    trie = spark.sparkContext.broadcast(keys)
    dealt = table.mapInArrow(_route(trie), "shard int, path binary, conv_id long, words array<int>")
    dealt = dealt.repartitionById(len(keys) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    nodes = stage(dealt.mapInArrow(_build(trie), _NODE), "nodes")
    where = ["splitter", "depth"]
    parts = nodes.where("shared").groupBy(*where).agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"))
    pieces = nodes.where("ids is not null").select(*where, "shard", "number", "ids").repartition(*where).sortWithinPartitions(*where, "shard", "number")
    ends = pieces.select(*where, "ids").mapInArrow(_hashes, "splitter int, depth int, ends string")
    whole = parts.join(ends, where, "left").select("*", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"), F.col("n_leaves").alias("local_leaves"), F.col("saved_tokens").alias("local_saved"), F.lit(None).cast("long").alias("parent_conv_id")).drop("ends")
    top = stage(whole.coalesce(1).mapInArrow(_upwards(trie), _SUMS), "skeleton")
    upper = top.select(F.col("splitter").alias("parent_splitter"), F.col("depth").alias("d"), F.col("conv_id").alias("upper"))
    if Skeleton(keys).size <= BROADCAST_NODES:
        upper = F.broadcast(upper)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    local = nodes.where("not shared")
    inner = local.where("parent_splitter is null").select(*out)
    edge = local.where("parent_splitter is not null").withColumn("d", F.col("depth") - 1).drop("parent_conv_id").join(upper, ["parent_splitter", "d"]).withColumnRenamed("upper", "parent_conv_id").select(*out)
    return inner.unionByName(edge).unionByName(top.select(*out)).withColumn("depth", F.col("depth").cast("long"))

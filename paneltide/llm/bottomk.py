"""Near-duplicate documents by bottom-k sketches of word shingles.

1. Each text becomes the set of its distinct shingles, hashed to 64 bits.  Texts
   with the same set are one class; from there on only classes move, so a group
   of copies of any size is one row.
2. A class's sketch is its K smallest hash values.  Inverted lists, value to
   classes, generate candidates.  Two classes of similarity s share about s of
   their union's sketch, so a class needs ``needed`` values in common with
   another one; values that nobody shares are dropped, and of the others only
   the rarest are listed, as many as make sure that two such classes meet.
3. In short lists (up to HOT classes) all classes meet, at most HOT a class.
   The classes of longer lists are grouped: connected components of "in one
   long list".  A group is cut into blocks of bounded size, every two blocks of
   it are one task, and a task counts overlaps by inverted lists over the full
   sets.  It returns a spanning forest of the links it finds, never its pairs.
4. A pair of a short list passes if the sketch of its union says so, and is
   then verified on the full sets, computed from the texts again.
5. Connected components of the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keyed, mix, rolling, signed, slices, stage, utf8, with_keys, word_hashes, word_spans
from .components import components

WORDS, PERCENT = 5, 75
#: Values a sketch keeps, and how many of a full union sketch two linked classes must share at least.
#: At similarity 0.75 the count shared is 36 of 48 on average; it stays below 18 with a chance under 1e-7.
K, FLOOR = 48, 18
#: Longest list whose classes all meet in a join.
HOT = 32
#: Classes, and bytes of text, of a block of a group.
BLOCK, BLOCK_BYTES = 1024, 4 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice (A-Z lower-cased; fewer words: the whole sequence as one; none: empty)."""
    starts, ends, edge = word_spans(data, offsets)
    value = word_hashes(data, starts, ends, lower=True)
    runs = mix(rolling(value, words))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a:b - words + 1]))
        elif b > a:
            out.append(mix(rolling(value[a:b], b - a) ^ np.uint64(0xA24BAED4963EE407 * (b - a) % (1 << 64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingles(*utf8(part.column("text")))
            ids = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
            kept = [signed(s[:K]) for s in sets]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in kept])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept) if kept else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("text_key"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), lists],
                                             ["row_id", "text_key", "doc_id", "n", "set_id", "sketch"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text_a"):
            left, right = shingles(*utf8(part.column("text_a"))), shingles(*utf8(part.column("text_b")))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - both
            keep = pa.array(100 * both >= PERCENT * union)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])


def needed(size: Column) -> Column:
    """Sketch values that a class with a sketch of ``size`` shares with any class it is linked with.

    If the union fits the sketch, the sketch is the set: exactly 75 of 100
    of it; else FLOOR.
    """
    full = math.ceil(K * PERCENT / 100)
    return F.when(size < full, F.ceil(size * PERCENT / F.lit(100))).otherwise(F.lit(FLOOR)).cast("int")


def alike(n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes can be linked."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT


def inverted_lists(sets: DataFrame) -> DataFrame:
    """value, set_id, n, m (classes of the list): the rarest shared values of each class's sketch, as many as it takes to meet every class it is linked with."""
    every = sets.select("set_id", "n", F.explode("sketch").alias("value"))
    often = every.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    own = W.partitionBy("set_id")
    ranked = every.join(often, "value").select("*", F.count("*").over(own).alias("shared"), F.row_number().over(own.orderBy("f", "value")).alias("rank"))
    least = needed(F.least(F.col("n"), F.lit(K)).cast("int"))
    lists = stage(ranked.where((F.col("shared") >= least) & (F.col("rank") <= F.col("shared") - least + 1)).select("value", "set_id", "n"), "lists")
    return lists.join(lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1"), "value")


def short_links(lists: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links a < b of classes that meet in a short list."""
    short = lists.where(F.col("m") <= HOT)
    other = short.select("value", F.col("set_id").alias("b"), F.col("n").alias("n_b"))
    pairs = short.join(other, "value").where((F.col("set_id") < F.col("b")) & alike(F.col("n"), F.col("n_b"))).select(F.col("set_id").alias("a"), "b").distinct()
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, K)
    near = stage(pairs, "pairs").join(side("a"), "a").join(side("b"), "b").withColumn("union", union)
    shared = F.size(F.array_intersect("union", F.array_intersect("sketch_a", "sketch_b")))
    least = F.when(F.size("union") < K, F.ceil(F.size("union") * PERCENT / F.lit(100))).otherwise(F.lit(FLOOR))
    near = stage(near.where(shared >= least).select("a", "b"), "near")
    text = lambda x: texts.select(F.col("set_id").alias(x), F.col("text").alias(f"text_{x}"))
    return near.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _forest(table: pa.Table) -> pa.Table:
    """Links within one block, or between two, of a group: a spanning forest of them."""
    table = table.combine_chunks()
    ids, block = table.column("set_id").to_pylist(), np.array(table.column("block").to_pylist())
    sets = [s for batch in table.select(["text"]).to_batches() for part in slices(batch) for s in shingles(*utf8(part.column("text")))]
    size = np.array([len(s) for s in sets], np.int64)
    one = block.min() == block.max()
    left = np.flatnonzero(block == block.min())
    right = left if one else np.flatnonzero(block == block.max())
    value = np.concatenate([sets[j] for j in right])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], np.repeat(np.arange(len(right)), size[right])[order]
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in left.tolist():
        low, high = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
        n = high - low
        stop = np.cumsum(n)
        both = np.bincount(owner[np.repeat(low - stop + n, n) + np.arange(int(n.sum()))], minlength=len(right))
        for j in right[100 * both >= PERCENT * (size[i] + size[right] - both)].tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[x] = y
                out.append((ids[i], ids[j]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def long_links(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a spanning forest of each task's) of classes that meet in a long list."""
    hot = lists.where(F.col("m") > HOT)
    centre = hot.groupBy("value").agg(F.min("set_id").alias("b"))
    groups = components(hot.join(centre, "value").select(F.col("set_id").alias("a"), "b").distinct(), "groups")
    member = groups.select(F.col("node").alias("set_id"), F.col("component").alias("group")).join(texts, "set_id")
    total = member.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = member.join(total, "group").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    return met.select(*keys, "block", "set_id", "text").groupBy("group", "low", "high").applyInArrow(_forest, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row_id, text_key, doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets have a Jaccard similarity of
    0.75 or more; ``component_id`` is the smallest ``doc_id`` that links reach
    (null ids don't count; null if there's no other).  Texts without words are
    linked with nothing, equal ones included.  Rows that repeat an id are all
    kept if the first one is.  Empty input: no rows.
    """
    rows = stage(keyed(docs).mapInArrow(_sketch, "row_id long, text_key long, doc_id long, n long, set_id long, sketch array<long>"), "sketches")
    sets = stage(rows.where("set_id is not null").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("row_id", "text_key")).alias("at")), "sets")
    lists = stage(inverted_lists(sets), "lists")
    listed = lists.select("set_id").distinct().join(sets.select("set_id", "at.*"), "set_id")
    texts = stage(keyed(docs).select("row_id", "text_key", "text").join(listed, ["row_id", "text_key"]).dropDuplicates(["set_id"]).select("set_id", "text"), "texts")
    links = stage(short_links(lists, sets, texts), "links").union(stage(long_links(lists, texts), "links"))
    labels = components(links).select(F.col("node").alias("set_id"), "component")
    first = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    reach = first.join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    # the smallest id of each component; a component without a link is its class
    low = reach.groupBy("component").agg(F.min("doc_id").alias("low"))
    of = stage(reach.join(low, "component").select("set_id", "low"), "reach")
    out = rows.select("row_id", "text_key", "doc_id", F.col("n").alias("n_shingles"), "set_id").join(of, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return out.select("row_id", "text_key", "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest ``doc_id``; of rows that repeat id and text, one."""
    kept = near_duplicates(docs).where("kept").select("row_id", "text_key").distinct()
    rows = with_keys(docs).join(kept, ["row_id", "text_key"])
    return rows.dropDuplicates(["row_id", "text_key"]).select("own.*")

"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

A window is repeated if its word sequence starts anywhere else.  Counting
all windows of a corpus moves one row per word, so windows that can't repeat
are told first: every window holds an anchor, the smallest hash of the runs of
ANCHOR words in it.  Equal windows have equal anchors at equal places, so a
window whose anchors are all unique in the corpus is unique.  Anchors are few
(about two in WINDOW - ANCHOR + 2 words); their values are counted first.  Then the
remaining windows are hashed whole and counted, and the starts of repeated ones
merge into maximal removal intervals.

Counts are folded in the map tasks: windows that already repeat in one slice of
texts are known there and send one row for all.  Of exact copies only one sends
its windows, with the weight of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, mix, per_document, rolling, signed, slices, sliding, stage, utf8, word_hashes, word_spans

WINDOW, ANCHOR = 35, 16
#: An anchor value with more than one in so many of all anchors is hot.
SHARES = 1000
_SECOND = 0xAF251AF3B0F025B5


def _anchors(window: int, size: int):
    """Places whose run of ``size`` words is the smallest of some window."""
    span = window - size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                starts, ends, edge = word_spans(data, offsets)
                if len(starts) < window:
                    continue
                value = mix(rolling(word_hashes(data, starts, ends), size)) | np.uint64(1)  # above 0, which stands for no window
                low = sliding(np.minimum, value, span)
                low = np.where(per_document(low, edge, window), low, np.uint64(0))
                pad = np.zeros(span - 1, np.uint64)
                # a place is an anchor if a window that holds it has no smaller value
                most = sliding(np.maximum, np.concatenate([pad, low, pad]), span)[:len(value)]
                at = np.flatnonzero(most == value)
                doc = np.searchsorted(edge, at, "right") - 1
                take = lambda c, doc=doc, part=part: part.column(c).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(signed(value[at])), take("row_id"), take("text_key"), pa.array((at - edge[doc]).astype(np.int32))], ["value", "row_id", "text_key", "place"])

    return run


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]


def _windows(window: int, size: int):
    """Hashes of the windows that hold a repeated anchor; those that repeat in the slice as ranges of starts, with one row for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                starts, ends, edge = word_spans(data, offsets)
                places = part.column("places")
                doc = np.repeat(np.arange(len(part)), np.diff(places.offsets.to_numpy()))
                at = places.flatten().to_numpy(zero_copy_only=False) + edge[doc]
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, np.maximum(edge[doc], at - (window - size)), 1)
                np.add.at(step, np.minimum(at, edge[doc + 1] - window) + 1, -1)
                chosen = np.flatnonzero(np.cumsum(step)[:len(starts)] > 0)
                if not len(chosen):
                    continue
                words = word_hashes(data, starts, ends)
                one, two = mix(rolling(words, window))[chosen], (mix(rolling(words, window, _SECOND))[chosen] >> np.uint64(33)).astype(np.int64)
                _, first, back, n = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
                again = n[back] > 1
                of = np.searchsorted(edge, chosen, "right") - 1
                copied = part.column("copied").to_numpy(zero_copy_only=False)[of]
                rows = []
                sent = np.flatnonzero(~again & ~copied)  # to be told by the corpus
                rows.append((one[sent], two[sent], of[sent], chosen[sent] - edge[of[sent]], chosen[sent] - edge[of[sent]], 1))
                heads = np.unique(np.concatenate([first[n > 1], np.flatnonzero(~again & copied)]))  # known: only others learn from them
                rows.append((one[heads], two[heads], None, None, None, 2))
                known = chosen[again & ~copied]
                if len(known):
                    a, b = _ranges(known + of[again & ~copied])  # documents apart by one
                    d = np.searchsorted(edge + np.arange(len(edge)), a, "right") - 1
                    rows.append((None, None, d, a - d - edge[d], b - d - edge[d], 0))
                for h, g, d, a, b, w in rows:
                    m = len(h if h is not None else d)
                    if m:
                        none = pa.nulls(m, pa.int64())
                        take = lambda c, d=d, part=part, none=none: none if d is None else part.column(c).take(pa.array(d))
                        yield pa.RecordBatch.from_arrays([none if h is None else pa.array(signed(h)), none if g is None else pa.array(g), take("row_id"), take("text_key"),
                                                          none if a is None else pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), pa.array(np.full(m, w))],
                                                         ["one", "two", "row_id", "text_key", "first", "last", "weight"])

    return run


def repeated_starts(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR) -> DataFrame:
    """row_id, text_key, copied, spans: for each document with a repeated window, whether its whole text repeats, or the ranges (first, last) of the starts."""
    rows = keyed(docs)
    keys = ["row_id", "text_key"]
    same = rows.select(*keys, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    copies = same.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min(F.struct(*keys)).alias("first")).where("n > 1")
    copied = stage(same.join(copies, ["t1", "t2"]).select(*keys, (F.struct(*keys) == F.col("first")).alias("sends")).distinct(), "copied")
    anchors = stage(rows.select(*keys, "text").mapInArrow(_anchors(window, size), "value long, row_id long, text_key long, place int"), "anchors")
    often = stage(anchors.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "often")
    total = anchors.count()
    # fewer than SHARES values hold more than that share of all anchors: they are told where the anchors lie, not by a shuffle
    hot = F.broadcast(often.where(F.col("n") * SHARES > F.lit(total)).select("value"))
    rest = anchors.join(hot, "value", "left_anti").join(often.where(F.col("n") * SHARES <= F.lit(total)).select("value"), "value", "left_semi")
    spots = anchors.join(hot, "value", "left_semi").unionByName(rest).groupBy(*keys).agg(F.collect_list("place").alias("places"))
    spots = stage(spots.join(copied, keys, "left").where("sends is null or sends").select(*keys, "places", F.col("sends").isNotNull().alias("copied")), "spots")
    found = stage(rows.select(*keys, "text").join(spots, keys).dropDuplicates(keys).select(*keys, "text", "places", "copied")
                  .mapInArrow(_windows(window, size), "one long, two long, row_id long, text_key long, first long, last long, weight long"), "windows")
    hashed = found.where("one is not null")
    twice = hashed.groupBy("one", "two").agg(F.sum("weight").alias("n")).where("n > 1").select("one", "two")
    told = hashed.where("row_id is not null").join(twice, ["one", "two"], "left_semi").unionByName(found.where("one is null"))
    spans = told.groupBy(*keys).agg(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))).alias("spans"))
    whole = copied.select(*keys, F.lit(True).alias("copied"))
    return stage(spans.join(whole, keys, "full").select(*keys, F.coalesce("copied", F.lit(False)).alias("copied"), "spans"), "spans")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, removed, texts = [], [], []
                for text, copied, spans in zip(part.column("text").to_pylist(), part.column("copied").to_pylist(), part.column("spans"), strict=True):
                    words = text.encode().split()  # bytes split at the six ASCII white-space characters only
                    n = len(words)
                    gone: list[dict] = []
                    if copied:
                        gone = [{"first": 0, "last": n - 1}] if n >= window else []
                    elif spans.is_valid:
                        first, last = (spans.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
                        step = np.zeros(n + 1, np.int64)
                        np.add.at(step, first, 1)
                        np.add.at(step, last + window, -1)  # the last window's words
                        a, b = _ranges(np.flatnonzero(np.cumsum(step)[:n] > 0))
                        gone = [{"first": x, "last": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    if gone:
                        kept, at = [], 0
                        for g in gone:
                            kept += words[at:g["first"]]
                            at = g["last"] + 1
                        words = kept + words[at:]
                    counts.append(n)
                    removed.append(gone)
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(texts, pa.string())],
                                                 ["doc_id", "n_words", "removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, removed (maximal intervals of word numbers, last one included), kept_text (words joined by one space).

    A word goes if a window over it starts anywhere else too, in its own or
    another text.  Null and empty texts have no words.  Rows that repeat id
    and text are copies of each other.  Empty input: no rows.
    """
    keys = ["row_id", "text_key"]
    out = keyed(docs).join(repeated_starts(docs, window, size), keys, "left")
    return out.select("doc_id", "text", "copied", "spans").mapInArrow(_cut(window), "doc_id long, n_words long, removed array<struct<first:int,last:int>>, kept_text string")

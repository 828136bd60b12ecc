"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, run once over every text.

Normal form of a text: A-Z in lower case, words are runs of digits, a-z and
characters beyond ASCII.  Lower-casing and blanking are byte for byte, so a
word's place in the normal form is its place in the original, and hits come
back with offsets there (code points).  A window is ``window`` consecutive
words of an item; a shorter item with words is one window.

The automaton reads numbers of words: a word of the items' vocabulary is
two digits (of different kinds, so that matches can't start inside a word), any other
word breaks every match.  Nodes then have few branches whatever the vocabulary.

Items are made into (window, item) rows by Spark and dealt by hash to blocks of
about ``BLOCK_WORDS`` words, which bounds the automaton of a task and what is broadcast.
A usual benchmark is one block: no text is shuffled or written.  Each further
block is one more pass, which adds its hits to the rows of the pass before.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WINDOW = 10
#: Words in the windows of one automaton: about 120 MB of nodes in a Python worker.
BLOCK_WORDS = 1_000_000
#: Bytes of a text that are cut into words at once; the automaton's state is carried over.
PIECE = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_HITS = "array<struct<first:int,last:int,start:int,end:int>>"


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``win`` (words joined by blanks), ``item`` (item_id as a string), each pair once; null and wordless texts give none."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("win")).distinct()


class _Automaton:
    def __init__(self, rows: list[tuple[str, str | None]]) -> None:
        self.items: list[list[str]] = []
        places: dict[str, int] = {}
        for win, item in rows:
            k = places.setdefault(win, len(places))
            if k == len(self.items):
                self.items.append([])
            if item is not None:
                self.items[k].append(item)
        split = [w.encode().split(b" ") for w in places]
        vocabulary = sorted({x for w in split for x in w})
        self.number = {x: i + 1 for i, x in enumerate(vocabulary)}
        self.base = math.isqrt(len(vocabulary)) + 1
        self.size = [len(w) for w in split]
        self.search = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, w in enumerate(split):
            self.search.add_word(tuple(self._digits(np.array([self.number[x] for x in w])).tolist()), k)
        if split:
            self.search.make_automaton()

    def _digits(self, numbers: np.ndarray) -> np.ndarray:
        """Two digits a word: the first below ``base``, the second above it; 0 stays 0, 0."""
        out = np.zeros((len(numbers), 2), np.int64)
        known = numbers > 0
        out[known, 0] = numbers[known] // self.base + 1
        out[known, 1] = numbers[known] % self.base + self.base + 2
        return out.ravel()

    def find(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a normal form, the ranges of hit words (merged, last one included), the items hit."""
        get, found, items = self.number.get, [], set()
        n = at = read = 0  # words cut, bytes cut, words that the automaton has read
        run = None
        while at < len(data):
            end = at + PIECE if at + PIECE < len(data) else len(data)
            if end < len(data):  # cut at a blank: a word stays whole
                cut = data.find(b" ", end)
                end = len(data) if cut < 0 else cut
            numbers = np.fromiter((get(w, 0) for w in data[at:end].split()), np.int64)
            at = end
            known = numbers > 0
            if known.any() and self.size:
                keep = known.copy()
                keep[0] = True
                keep[1:] |= known[:-1]  # of a run of other words the first one breaks the match
                place = np.flatnonzero(keep)
                symbols = tuple(self._digits(numbers[place]).tolist())
                if run is None:
                    run = self.search.iter(symbols)
                else:
                    run.set(symbols, False)
                for stop, k in run:
                    last = n + int(place[stop // 2 - read])
                    found.append((last - self.size[k] + 1, last))
                    items.update(self.items[k])
                read += len(place)
            elif run is not None and len(numbers):  # nothing known: the match breaks
                run.set((0, 0), False)
                list(run)
                read += 1
            n += len(numbers)
        return n, _merge(found), items


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _offsets(data: bytes, raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges of words with their code points in the original text, end exclusive."""
    if not ranges:
        return []
    b = np.frombuffer(data, np.uint8)
    inside = b != 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    more = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)  # bytes that don't begin a code point
    point = lambda at: int(at - np.searchsorted(more, at))
    return [{"first": x, "last": y, "start": point(starts[x]), "end": point(ends[y])} for x, y in ranges]


_HELD: dict[str, _Automaton] = {}


def _scan(name: str, block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HELD:  # one automaton a worker
            _HELD.clear()
            _HELD[name] = _Automaton(block.value)
        search = _HELD[name]
        for batch in batches:
            n_words, hits, items = [], [], []
            text, old_hits, old_items = (batch.column(c) for c in ("txt", "hits", "items"))
            for i in range(batch.num_rows):
                raw = (text[i].as_py() or "").encode()
                data = raw.translate(_NORMAL)
                n, found, ids = search.find(data)
                before = old_hits[i].as_py() or []
                if before and found:
                    found = _merge(found + [(h["first"], h["last"]) for h in before])
                n_words.append(n)
                hits.append(_offsets(data, raw, found) if found else before)
                items.append(sorted(ids.union(old_items[i].as_py() or [])))
            kind = {f.name: f.type for f in batch.schema}
            yield pa.RecordBatch.from_arrays([batch.column("own"), text, pa.array(n_words, pa.int64()), pa.array(hits, kind["hits"]), pa.array(items, kind["items"])],
                                             ["own", "txt", "n_words", "hits", "items"])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``own`` (a struct of all columns of ``docs``), ``n_words``, ``hits``, ``items``: one row per row of ``docs``.

    ``hits`` are the merged ranges of hit words: numbers of the first and last
    word, start and end (exclusive) in code points of the original text.  ``items`` are the ids
    (strings, ascending) of the items of which a window occurs.  Null texts
    have no words and no hits.  Items of null id hit words but aren't listed;
    items of one id are one item.  Repeated rows, ids and null ids of ``docs`` are rows of their own.  No
    items: no hits; no documents: no rows.
    """
    spark = docs.sparkSession
    # pairs go to the blocks by hash: a window that many items share is spread too
    pairs = stage(windows(items, window), "windows")
    blocks = max(1, math.ceil(pairs.count() * window / block_words))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("text").alias("txt"),
                      F.lit(0).cast("long").alias("n_words"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("win", "item"), F.lit(blocks)) == k).select("win", "item").toPandas()
        block = spark.sparkContext.broadcast(list(zip(rows["win"], [x if isinstance(x, str) else None for x in rows["item"]], strict=True)))
        out = out.mapInArrow(_scan(uuid.uuid4().hex, block), out.schema)
        if k + 1 < blocks:
            out = stage(out, "scanned")
    return out.select("own", "n_words", "hits", "items")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids joined by commas), contaminated, hits for every row of ``docs``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + F.lit(1))
    return contamination(docs, items, window).select(
        F.col("own.doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "hits")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with their own columns, in which no window of an item occurs."""
    return contamination(docs, items, window).where(F.size("hits") == 0).select("own.*")

"""Token ids in files: Simple-8b words with escapes and per-block offsets.

File format: Parquet files in the shared folder, one row per chunk of documents
in ascending ``doc_id`` order.  ``payload`` holds little-endian 64-bit words; the
top 4 bits of a word are a selector that says how many ids of how many bits
fill the other 60.  Selector 15 is an escape: the following word is one raw
id.  Blocks of ``BLOCK`` ids start on a word of their own; ``block_words`` has
the first word of each, so blocks decode side by side and any id can be reached.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, range_bounds, range_bucket, slices, stage_path
from .unit_cache import UNIT_SLICE, UnitCache, assemble

#: (ids, bits) of selectors 0 to 13; 14 is unused, 15 the escape.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
#: Ids of a block.
BLOCK = 1024
#: Distinct words whose ids a Python worker remembers.
CACHE = 200_000
END_ID = 1


_WIDTH16 = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if not len(ids) or ids.max() < 1 << 16:
        return _WIDTH16[ids]
    out = np.zeros(len(ids), np.uint8)
    for shift in (48, 32, 16, 0):
        part = (ids >> np.uint64(shift)).astype(np.uint64) & np.uint64(0xFFFF)
        out = np.where((out == 0) & (part > 0), _WIDTH16[part] + np.uint8(shift), out)
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` (any unsigned 64-bit values), and the first word of each block.

    Each word takes the selector of most ids that fits the next ids of its
    block; all blocks advance together, one word a step.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n_blocks, most = -(-len(ids) // block), PACKS[0][0]
    row = block + most  # blocks apart by more than a word's ids that fit no selector
    width = np.full((n_blocks, row), 255, np.uint8)
    width.reshape(-1)[np.arange(len(ids)) // block * most + np.arange(len(ids))] = _widths(ids)
    flat = width.reshape(-1)
    choice = np.full(len(flat), ESCAPE, np.uint8)
    longest, reach = flat, 1  # the largest width of the next `reach` ids
    for selector in reversed(range(len(PACKS))):
        count, bits = PACKS[selector]
        while reach < count:
            step = min(reach, count - reach)
            longest = np.maximum(longest[:len(longest) - step], longest[step:])
            reach += step
        if longest.min() > bits:
            continue
        choice[:len(longest)][longest <= bits] = selector
    taken = np.array([c for c, _ in PACKS] + [0, 1])
    jump = taken[choice]
    pos = np.arange(n_blocks) * row
    end = pos + np.minimum(block, len(ids) - np.arange(n_blocks) * block)
    steps, live = [], np.arange(n_blocks)
    while len(live):
        here = np.full(n_blocks, -1)
        at = pos[live]
        here[live] = at
        steps.append(here)
        pos[live] = at + jump[at]
        live = live[pos[live] < end[live]]
    grid = np.stack(steps, 1)
    start = grid[grid >= 0]  # block by block
    per_block = (grid >= 0).sum(1)
    pick = choice[start]
    start -= start // row * most  # places in ids
    slots = 1 + (pick == ESCAPE)  # words each step takes
    place = np.cumsum(slots) - slots
    out = np.zeros(int(slots.sum()), np.uint64)
    for selector, (count, bits) in enumerate(PACKS):
        rows = np.flatnonzero(pick == selector)
        if len(rows):
            first = start[rows]
            word = np.full(len(rows), np.uint64(selector) << np.uint64(60))
            for k in range(count):
                word |= ids[first + k] << np.uint64(bits * k)
            out[place[rows]] = word
    rows = np.flatnonzero(pick == ESCAPE)
    out[place[rows]] = np.uint64(ESCAPE) << np.uint64(60)
    out[place[rows] + 1] = ids[start[rows]]
    return out, place[np.cumsum(per_block) - per_block]


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks of words, each selector's words at once."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):  # a raw word may look like an escape itself
        if not raw[i]:
            raw[i + 1] = True
    count = np.array([c for c, _ in PACKS] + [0, 1])[selector]
    count[raw] = 0
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s, (n, bits) in enumerate(PACKS):
        rows = np.flatnonzero((selector == s) & ~raw)
        if len(rows):
            shift = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            out[at[rows][:, None] + np.arange(n)] = (words[rows][:, None] >> shift) & np.uint64((1 << bits) - 1)
    rows = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[at[rows]] = words[rows + 1]
    return out


class WordIds:
    """Ids of texts, word by word: a tokenizer that never joins across white space gives each word the same ids anywhere.

    If the tokenizer lower-cases, words that differ in ASCII case share their
    ids (where no special token's text is near).  A word of plain lower-case
    letters between ASCII punctuation is cut there and its parts go straight to
    the library's merges, without the normaliser and splitter that leave them
    as they are; every other word takes the whole tokenizer.
    """

    #: Letters that composition and lower-casing leave alone; punctuation that makes one part (an apostrophe may start a suffix of its own).
    PLAIN = re.compile("([!-&(-/:-@\\[-`{-~]*)([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, cache: int = CACHE) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(marks) if marks else None
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.fold = ids("AB") == ids("ab") and self.mark != "" and not any(c.isalpha() for c in self.mark or "")
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(33, 127), *range(0xDF, 0x100)])}
        # the short way is taken only if it gives what the whole tokenizer gives
        self.short = all(self._parts(w) == ids(w) for w in ("the", "the.", "(\u00e9t\u00e9),", "stra\u00dfe!?", "a-b"))
        self.values, self.ends = UnitCache(self._learn, cache), {}

    def _merged(self, part: str) -> list[int]:
        if not part.isascii():
            part = "".join([self.letters[c] for c in part])
        return [t.id for t in self.model.tokenize(part)]

    def _parts(self, word: str) -> list[int] | None:
        found = self.PLAIN.fullmatch(word)
        if not found:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [i for part in found.groups() if part for i in self._merged(part)]

    def _learn(self, words: list[str]) -> list[bytes]:
        out, slow = [], []
        for word in words:
            found = self.PLAIN.fullmatch(word) if self.short and "<|" not in word else None
            if not found:
                slow.append(len(out))
                out.append(b"")
                continue
            head, core, tail = found.groups()
            x = array("I", self._merged(core)).tobytes()
            for part, last in ((head, False), (tail, True)):
                if part:
                    if len(part) < 4 and part not in self.ends:
                        self.ends[part] = array("I", self._merged(part)).tobytes()
                    y = self.ends.get(part) or array("I", self._merged(part)).tobytes()
                    x = x + y if last else y + x
            out.append(x)
        for i, x in zip(slow, self.tokenizer.encode_batch_fast([words[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = array("I", x.ids).tobytes()
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a string column, and how many each row has."""
        text = pc.fill_null(column, "")
        if self.fold and not (self.mark and pc.any(pc.match_substring(text, self.mark)).as_py()):
            text = pc.ascii_lower(text)
        split = pc.ascii_split_whitespace(text)
        return assemble(split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False), self.values)[:2]


_TOKENIZERS: dict[str, WordIds] = {}


def with_end(flat: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` after each document."""
    out = np.full(len(flat) + len(n), end, np.uint32)
    mask = np.ones(len(out), bool)
    mask[np.cumsum(n + 1) - 1] = False
    out[mask] = flat
    return out, n + 1


def _writer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordIds(path)
        seq = 0
        for batch in batches:
            for part in slices(batch, limit=UNIT_SLICE):
                shard = part.column("shard").to_numpy()
                for a, b in _runs(shard):
                    piece = part.slice(a, b - a)
                    ids, n = with_end(*_TOKENIZERS[path](piece.column("text")), end)
                    words, first = encode(ids)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(shard[a])], pa.int32()), pa.array([seq], pa.int64()), pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([first.tolist()], pa.list_(pa.int32())), pa.array([words.astype("<u8").tobytes()], pa.binary())],
                        ["shard", "seq", "doc_ids", "lengths", "n_ids", "block_words", "payload"])
                    seq += 1

    return run


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(x)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = END_ID) -> None:
    """Encode every whole text (null: empty) and write its ids and ``end`` to ``path``, ascending by ``doc_id`` (null first; ties by text).

    Contiguous ranges of ``doc_id`` are shards; a lost task is written again
    from the same rows in the same order.
    """
    spark = docs.sparkSession
    rows = documents(docs)
    bounds = range_bounds(rows.where("doc_id is not null"), "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.withColumn("shard", range_bucket(F.col("doc_id"), bounds).cast("int"))
    dealt = ranged.repartitionById(max(1, len(bounds) + 1), F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(_writer(tokenizer, end), "shard int, seq long, doc_ids array<long>, lengths array<long>, n_ids long, block_words array<int>, payload binary").write.option("compression", "zstd").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode(np.frombuffer(row["payload"], "<u8")).astype("<u4")
            stop = np.cumsum(row["lengths"])
            start = stop - row["lengths"]
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            n = len(start)
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                                             ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Chunks are decoded where they are read; only the documents' figures move.
    Shards' totals (one row per shard) give each shard's base, chunks are
    summed within their shard.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_base"))
    within = W.partitionBy("shard").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    chunks = files.select("shard", "seq", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("within"))
    bases = chunks.join(F.broadcast(bases), "shard").select("shard", "seq", (F.col("within") + F.col("shard_base")).alias("base"))
    read = files.select("shard", "seq", "doc_ids", "lengths", "payload").mapInArrow(_reader, "shard int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(bases, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    """Write ``docs`` to id files in the shared folder and return what ``read_ids`` reads back; empty input: no rows."""
    path = stage_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer, path, end)
    return read_ids(docs.sparkSession, path)

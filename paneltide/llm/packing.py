"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into pieces of
that length; the rest are items.  Items are dealt by hash to pools of bounded
size; each pool is packed on its own, longest first, every item into the
fullest open bin that still takes it.  Where none does, a bin of the least-cost
permitted length opens.  At the end every bin shrinks to the smallest permitted
length that holds its contents.  The lengths are chosen jointly: the pool is
packed once for each permitted largest opening and the cheapest plan is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Items that are packed together: bounds the memory of a task.
POOL = 20_000


def cost_of(capacity: int, attention: float = 1 / 16384) -> float:
    """Cost of a sequence: linear in its length, and attention's square."""
    return capacity * (1 + attention * capacity)


class _Open:
    """Open bins by free room; the fullest that takes an item is found by bit operations on one integer."""

    def __init__(self) -> None:
        self.rooms, self.mask = {}, 0

    def take(self, need: int) -> tuple[int, int] | None:
        over = self.mask >> need
        if not over:
            return None
        room = need + (over & -over).bit_length() - 1
        stack = self.rooms[room]
        bin_ = stack.pop()
        if not stack:
            self.mask &= ~(1 << room)
        return bin_, room

    def put(self, bin_: int, room: int) -> None:
        if room > 0:
            self.rooms.setdefault(room, []).append(bin_)
            self.mask |= 1 << room


def _plan(sizes: Sequence[int], lengths: Sequence[int], top: int, cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """Bin of every item, fill of every bin; ``sizes`` must descend.

    A bin opens with the length, up to ``top``, of least cost for what it can
    be filled with: all that is left, up to the length.  An item longer than
    ``top`` opens the least length that holds it.
    """
    left, open_, fills, where = sum(sizes), _Open(), [], []
    for size in sizes:
        found = open_.take(size)
        if found is None:
            fit = [c for c in lengths if c >= size]
            capacity = min([c for c in fit if c <= top] or fit[:1], key=lambda c: (cost(c) / max(1, min(c, left)), c))
            found = (len(fills), capacity)
            fills.append(0)
        bin_, room = found
        where.append(bin_)
        fills[bin_] += size
        open_.put(bin_, room - size)
        left -= size
    return where, fills


def pack_sizes(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = cost_of) -> tuple[list[int], list[int], list[int]]:
    """Bin of every item, fill and final length of every bin, for sizes from 0 to the largest capacity.

    Every permitted length in turn is the largest that bins open with; the
    plan of least cost after downsizing wins, on a tie the first.
    """
    lengths = sorted(set(capacities))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    down = [sizes[i] for i in order]
    shrink = lambda fill: next(c for c in lengths if c >= fill)
    best = None
    for top in lengths:
        where, fills = _plan(down, lengths, top, cost)
        total = sum(cost(shrink(f)) for f in fills)
        if best is None or total < best[0]:
            best = (total, where, fills)
    _, where, fills = best
    bins = [0] * len(sizes)
    for place, i in enumerate(order):
        bins[i] = where[place]
    return bins, fills, [shrink(f) for f in fills]


def _pools(capacities: Sequence[int], pool: int, cost: Callable[[int], float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, n
            table = pa.Table.from_batches(held)
            size = table.column("length").to_numpy()
            bins, fills, final = pack_sizes(size.tolist(), capacities, cost)
            bins, fills, final = np.array(bins, np.int64), np.array(fills, np.int64), np.array(final, np.int64)
            order = np.argsort(bins, kind="stable")  # within a bin, items lie in the order of the pool
            ends = np.cumsum(size[order])
            first = np.concatenate([[0], np.cumsum(fills)])[bins[order]]
            at = np.empty(len(size), np.int64)
            at[order] = ends - size[order] - first
            out = [(shard << 40 | number << 20) + bins, at, fills[bins], final[bins]]
            number, held, n = number + 1, [], 0
            return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length")], *map(pa.array, out)],
                                              ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_fill", "bin_capacity"])

        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, pool - n), batch.slice(min(pool - n, batch.num_rows))
                held.append(part)
                n += part.num_rows
                if n == pool:
                    yield flush()
        if n:
            yield flush()

    return run


def pack(items: DataFrame, capacities: Sequence[int] = CAPACITIES, pool: int = POOL, cost: Callable[[int], float] = cost_of) -> DataFrame:
    """Pack ``items`` (doc_id, length): one row per piece: doc_id, piece, start, length, bin_id, bin_offset, bin_fill, bin_capacity.

    A null or negative length counts as 0; an empty document takes no room but
    has its row.  Null and repeated ids are items like others.  Items are dealt by
    a hash of id, piece, length and a running number, so equal rows are spread; tasks
    pack their rows pool by pool.  Empty input: no rows.
    """
    largest = max(capacities)
    if min(capacities) < 1 or pool >= 1 << 20:
        raise ValueError("capacities must be positive, pools below 2^20 items")
    length = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0))
    cut = items.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("_n")).select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / largest)))).alias("piece"))
    pieces = cut.select("doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("_n") - F.col("piece") * largest).alias("length"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    dealt = pieces.withColumn("_s", F.xxhash64("doc_id", "piece", "length", salt))
    shards = dealt.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_s").sortWithinPartitions("_s", "doc_id", "piece").drop("_s")
    return shards.mapInArrow(_pools(tuple(capacities), pool, cost), "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, bin_fill long, bin_capacity long")


def document_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and length: words of the whole text and one end mark (null text: the end mark alone)."""
    words = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), WORD_SPLIT), lambda w: w != ""))
    return docs.select("doc_id", (words + 1).cast("long").alias("length"))

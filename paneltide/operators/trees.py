"""Regression trees over a frame that is binned once (used by M6 and M7).

``BinnedFrame`` cuts every feature into at most ``max_bins`` bins and keeps the rows as
blocks of bytes in a persisted RDD.  Growing one level of any number of trees
is then one job: each task counts its rows by (tree, node, feature, bin), the counts
meet by (tree, node), and the best split of a node is found where its counts
meet; only splits come back to the driver.  What is shuffled and sent depends on
the number of nodes and bins, not on the rows.

An RDD is used for these jobs because the loop has thousands of short ones: planning a DataFrame query takes
several times as long as such a job's work.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_BINS = 255
#: Points of a sketch; a quantile's rank is off by at most about one in this number for each merge.
SKETCH = 4096
#: Splits whose gains differ by less than this share of the sums are equal; the first feature and the lowest cut win.
TIE = 1e-10
#: Rows of a block; a task works on one block at a time.
BLOCK_ROWS = 10_000


# ---- weighted quantile sketches

def _thinned(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(values) <= size:
        return values, weights
    total = weights.sum()
    rank = (np.arange(size) + 0.5) * (total / size)
    picked = np.searchsorted(np.cumsum(weights), rank)
    kept, n = np.unique(picked, return_counts=True)
    return values[kept], n * (total / size)


def compress(values: np.ndarray, weights: np.ndarray, size: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """Equal values joined; beyond ``size`` different values, evenly spaced ranks of them."""
    values, at = np.unique(values, return_inverse=True)
    return _thinned(values, np.bincount(at, weights, len(values)), size)


def sketch(values: np.ndarray, size: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """``compress`` of values that count once each; sorted without their places, which takes a fraction of the time."""
    values, n = np.unique(values, return_counts=True)
    return _thinned(values, n.astype(np.float64), size)


def merge_sketches(a: tuple, b: tuple) -> tuple:
    return compress(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))


def sketch_quantile(values: np.ndarray, weights: np.ndarray, p: float) -> float:
    """The p-quantile with linear interpolation between neighbouring rows."""
    stop = np.cumsum(weights)
    place = p * (stop[-1] - 1)
    low, high = np.searchsorted(stop, [np.floor(place), np.floor(place) + 1], "right")
    high = min(int(high), len(values) - 1)
    return float(values[low] + (place - np.floor(place)) * (values[high] - values[low]))


# ---- trees

@dataclass
class Tree:
    """Nodes in order of creation, the root first.  A row goes left if its bin is <= ``cut`` (its value <= ``threshold``)."""

    feature: list = field(default_factory=lambda: [-1])  # -1: a leaf
    cut: list = field(default_factory=lambda: [0])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.threshold[node], self.left[node], self.right[node] = feature, cut, threshold, n, n + 1
        for _ in range(2):
            for column, default in zip((self.feature, self.cut, self.threshold, self.left, self.right, self.value), (-1, 0, 0.0, -1, -1, 0.0), strict=True):
                column.append(default)
        return n, n + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.cut, self.threshold, self.left, self.right, self.value))


def walk(tree: tuple[np.ndarray, ...], x: np.ndarray, binned: bool) -> np.ndarray:
    """The leaf of every row of ``x`` (bins, or values)."""
    feature, cut, threshold, left, right, _ = tree
    limit = cut if binned else threshold
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    live = rows[feature[node] >= 0]
    while len(live):
        at = node[live]
        node[live] = np.where(x[live, feature[at]] <= limit[at], left[at], right[at])
        live = live[feature[node[live]] >= 0]
    return node


def node_rows(columns: np.ndarray, tree: tuple[np.ndarray, ...], binned: bool) -> dict[int, np.ndarray]:
    """The rows of every leaf, in their order; ``columns`` is features x rows (bins, or values)."""
    feature, cut, threshold, left, right, _ = tree
    limit = cut if binned else threshold
    own = {0: np.arange(columns.shape[1])}
    for node in np.flatnonzero(feature >= 0).tolist():  # a node's number is lower than its children's
        own[int(left[node])], own[int(right[node])] = divide(columns, own.pop(node), feature[node], limit[node])
    return own


def divide(columns: np.ndarray, rows: np.ndarray, feature: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    goes_left = columns[feature].take(rows) <= limit
    return rows[goes_left], rows[~goes_left]


def places(columns: np.ndarray, tree: tuple[np.ndarray, ...], binned: bool) -> np.ndarray:
    """The leaf of every row, all rows a level at a time; ``columns`` is features x rows (bins, or values)."""
    feature, cut, threshold, left, right, _ = tree
    n, inner = columns.shape[1], feature >= 0
    node, row = np.zeros(n, np.intp), np.arange(n)
    level = np.zeros(len(feature), int)
    for k in np.flatnonzero(inner).tolist():  # a node's number is lower than its children's
        level[left[k]] = level[right[k]] = level[k] + 1
    own = np.arange(len(feature))
    base, left, right = np.where(inner, feature, 0) * n, np.where(inner, left, own), np.where(inner, right, own)
    limit, flat = cut.astype(columns.dtype) if binned else threshold, columns.reshape(-1)
    for _ in range(level.max()):
        goes_left = flat.take(base.take(node) + row) <= limit.take(node)
        node = np.where(goes_left, left.take(node), right.take(node))
    return node


def add_outputs(columns: np.ndarray, tree: tuple[np.ndarray, ...], out: np.ndarray, binned: bool) -> None:
    """Adds to ``out`` the value of every row's leaf."""
    out += tree[5].take(places(columns, tree, binned))


# ---- the binned frame

def _edge_sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None] * width
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            for f in range(width):
                col = x[:, f][~np.isnan(x[:, f])]
                new = sketch(col)
                held[f] = new if held[f] is None else merge_sketches(held[f], new)
        live = [f for f in range(width) if held[f] is not None]
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([held[f][0] for f in live], pa.list_(pa.float64())), pa.array([held[f][1] for f in live], pa.list_(pa.float64()))],
                                         ["feature", "v", "w"])

    return run


def _edges(max_bins: int):
    def run(group: pa.Table) -> pa.Table:
        sketch = None
        for v, w in zip(group.column("v").to_pylist(), group.column("w").to_pylist(), strict=True):
            new = (np.array(v, float), np.array(w, float))
            sketch = new if sketch is None else merge_sketches(sketch, new)
        values, weights = sketch
        if len(values) > max_bins:
            rank = np.arange(1, max_bins) * (weights.sum() / max_bins)
            values = values[np.unique(np.searchsorted(np.cumsum(weights), rank))]
        else:
            values = (values[:-1] + values[1:]) / 2  # between two values, so that new ones fall to the nearer side
        return pa.table({"feature": group.column("feature").slice(0, 1), "edges": pa.array([values], pa.list_(pa.float64()))})

    return run


def feature_edges(rows: DataFrame, width: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cut points of each feature of ``rows`` (``x``: array<double>); at most ``max_bins - 1``."""
    sketches = rows.select("x").mapInArrow(_edge_sketches(width), "feature int, v array<double>, w array<double>")
    got = {r["feature"]: r["edges"] for r in sketches.groupBy("feature").applyInArrow(_edges(max_bins), "feature int, edges array<double>").collect()}
    return [np.array(got.get(f, [])) for f in range(width)]


@dataclass
class Block:
    bins: np.ndarray  # rows x features
    y: np.ndarray  # rows x labels
    ids: np.ndarray  # row numbers, unique in the frame


def to_blocks(edges: list[np.ndarray], labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(a, BLOCK_ROWS)
                n = part.num_rows
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, len(edges))
                y = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, labels)
                bins = np.empty((n, len(edges)), np.uint8)
                for f, cuts in enumerate(edges):
                    bins[:, f] = np.searchsorted(cuts, x[:, f], "left")  # a NaN lies behind all cuts
                yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(y, np.float64).tobytes()], pa.binary()), pa.array([part.column(2).to_numpy().tobytes()], pa.binary())],
                                                 ["bins", "y", "ids"])

    return run


def _with_labels(frame: DataFrame, features: str, labels: list[str]) -> DataFrame:
    rows = frame.where(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("y"))
    return rows.where(F.forall("y", lambda v: v.isNotNull() & ~F.isnan(v)))


class BinnedFrame:
    """The training rows as blocks of bins; ``rdd`` is persisted until ``free``."""

    def __init__(self, frame: DataFrame, features: str, labels: list[str], max_bins: int = MAX_BINS) -> None:
        if max_bins > 256:
            raise ValueError("at most 256 bins")
        rows = _with_labels(frame, features, labels)
        first = rows.select("x").first()
        if first is None:
            raise ValueError("no training rows with a label")
        self.labels = labels
        self.edges = feature_edges(rows, len(first["x"]), max_bins)
        self.size = np.array([len(e) + 1 for e in self.edges])
        self.offset = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.total = int(self.size.sum())
        self.layout = (self.offset, self.size, self.total)
        table = rows.withColumn("id", F.monotonically_increasing_id()).mapInArrow(to_blocks(self.edges, len(labels)), "bins binary, y binary, ids binary")
        self.table = table = cut_lineage(table)  # binned once, row numbers settled
        width, n_labels = len(self.edges), len(labels)

        def block(r) -> Block:
            bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, width)
            return Block(bins, np.frombuffer(r["y"]).reshape(-1, n_labels), np.frombuffer(r["ids"], np.int64))

        self._block = block
        self.rdd: RDD = table.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)
        self.rows = self.rdd.map(lambda b: len(b.bins)).sum()
        # small frames in few tasks: a task costs more than a few thousand rows
        parts = max(1, min(self.rdd.getNumPartitions(), -(-self.rows // 4096)))
        if parts < self.rdd.getNumPartitions():
            whole = self.rdd
            self.rdd = whole.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
            self.rdd.count()
            whole.unpersist()
        self.meet = min(parts, 64)

    def blocks_of(self, frame: DataFrame, features: str) -> RDD:
        """Other rows in this frame's bins; rows without a label or features are left out, as in the frame."""
        rows = _with_labels(frame, features, self.labels).withColumn("id", F.monotonically_increasing_id())
        return rows.mapInArrow(to_blocks(self.edges, len(self.labels)), "bins binary, y binary, ids binary").rdd.map(self._block)

    def threshold(self, feature: int, cut: int) -> float:
        return float(self.edges[feature][cut])

    def free(self) -> None:
        self.rdd.unpersist()


def best_split(count: np.ndarray, total: np.ndarray, offset: np.ndarray, size: np.ndarray, least: float) -> tuple | None:
    """(gain, feature, cut, left count, left sum, count, sum) of the split that lowers the squared error most, or None."""
    n, s = count[:size[0]].sum(), total[:size[0]].sum()  # a feature's bins hold all rows
    base = np.repeat(offset, size)
    cn, cs = np.concatenate([[0.0], np.cumsum(count)]), np.concatenate([[0.0], np.cumsum(total)])
    left_n, left_s = cn[1:] - cn[base], cs[1:] - cs[base]
    right_n, right_s = n - left_n, s - left_s
    ok = (left_n >= least) & (right_n >= least) & (left_n > 0) & (right_n > 0)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left_s**2 / left_n + right_s**2 / right_n - s**2 / n, -np.inf)
    most = gain.max()
    k = int(np.argmax(gain >= most - TIE * (abs(most) + s**2 / n)))
    if not gain[k] > TIE * max(1e-9, s**2 / n):
        return None
    f = int(np.searchsorted(offset, k, "right") - 1)
    return float(gain[k]), f, int(k - offset[f]), float(left_n[k]), float(left_s[k]), float(n), float(s)


def histogram(bins: np.ndarray, slot: np.ndarray, weight: np.ndarray | None, value: np.ndarray, offset: np.ndarray, total: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slot, rows by bin, sums by bin) of the rows with slot >= 0; slots without rows give nothing.  Values are numbers, or true and false."""
    live = np.flatnonzero(slot >= 0)
    if not len(live):
        return
    names, back = np.unique(slot[live], return_inverse=True)
    step = max(1, (1 << 22) // total)  # slots at once, which bounds the memory
    for a in range(0, len(names), step):
        own = np.flatnonzero((back >= a) & (back < a + step))
        rows = live[own]
        at = bins[rows] + (offset + ((back[own] - a) * total)[:, None])
        n = min(step, len(names) - a) * total
        if value.dtype == bool and weight is None:
            count, sums = np.bincount(at.ravel(), None, n), np.bincount(at[value[rows]].ravel(), None, n)
        else:
            wide = lambda x, at=at: np.repeat(x, at.shape[1])
            w = np.ones(len(rows)) if weight is None else weight[rows]
            count, sums = np.bincount(at.ravel(), wide(w), n), np.bincount(at.ravel(), wide(w * value[rows]), n)
        for k in range(min(step, len(names) - a)):
            yield int(names[a + k]), count[k * total:(k + 1) * total].astype(np.float64), sums[k * total:(k + 1) * total].astype(np.float64)


def counted(columns: np.ndarray, groups: list[np.ndarray], value: np.ndarray, offset: np.ndarray, size: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by bin and sums by bin of each group of rows, one feature at a time; values are numbers, or true and false."""
    rows = groups[0] if len(groups) == 1 else np.concatenate(groups)
    return counted_slots(columns, rows, np.repeat(np.arange(len(groups)), [len(g) for g in groups]), len(groups), value, offset, size, total)


def counted_slots(columns: np.ndarray, rows: np.ndarray, slot: np.ndarray, n: int, value: np.ndarray, offset: np.ndarray, size: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """``counted`` of ``rows`` in ``n`` slots, in any order."""
    flags = value.dtype == bool
    every = n == 1 and len(rows) == columns.shape[1]
    value = value if every else value.take(rows)
    base = slot * (512 if flags else 256)
    if flags:
        base += value.astype(np.int64) << 8
    count, sums = np.empty((n, total)), np.empty((n, total))
    for f, column in enumerate(columns):
        a, b = offset[f], offset[f] + size[f]
        at = base + (column if every else column.take(rows))
        if flags:
            both = np.bincount(at, None, n * 512).reshape(n, 2, 256)[:, :, :size[f]]
            count[:, a:b], sums[:, a:b] = both.sum(1), both[:, 1]
        else:
            count[:, a:b] = np.bincount(at, None, n * 256).reshape(n, 256)[:, :size[f]]
            sums[:, a:b] = np.bincount(at, value, n * 256).reshape(n, 256)[:, :size[f]]
    return count, sums


def counted_flags(columns: np.ndarray, flags: list[np.ndarray], offset: np.ndarray, size: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all rows, the rows by bin and each flag's true rows by bin, in one pass."""
    base, n = np.zeros(columns.shape[1], np.int64), 1 << len(flags)
    for i, flag in enumerate(flags):
        base += flag.astype(np.int64) << (8 + i)
    own = [[c for c in range(n) if c >> i & 1] for i in range(len(flags))]
    count, sums = np.empty(total), np.empty((len(flags), total))
    for f, column in enumerate(columns):
        a, b = offset[f], offset[f] + size[f]
        all_of = np.bincount(base + column, None, n * 256).reshape(n, 256)[:, :size[f]]
        count[a:b] = all_of.sum(0)
        for i, c in enumerate(own):
            sums[i, a:b] = all_of[c].sum(0)
    return count, sums


def slot_counts(frame: BinnedFrame, rows_of: Callable) -> Callable:
    """For ``level_splits``: ``rows_of(block)`` yields (key of each slot, slot of each row or -1, weights, values)."""
    offset, total = frame.offset, frame.total

    def run(b):
        for keys, slot, weight, value in rows_of(b):
            for k, n, s in histogram(b.bins, slot, weight, value, offset, total):
                yield keys[k], n, s

    return run


def _short(x: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes, others as they are."""
    whole = x.astype(np.int32) if len(x) and np.abs(x).max() < 2**31 else x
    return whole if np.array_equal(whole, x) else x


def packed(counts: Iterator, total: int) -> Iterator[tuple]:
    """(key, rows by bin, sums by bin) added up by key, as (key, what is sent)."""
    held: dict = {}
    for key, n, s in counts:
        if key in held:
            held[key][0] += n
            held[key][1] += s
        else:
            held[key] = [n, s]
    for key, (n, s) in held.items():
        full = np.flatnonzero(n)
        if len(full) * 2 < total:  # few bins are taken: only those are sent
            yield key, (full.astype(np.int32), _short(n[full]), _short(s[full]))
        else:
            yield key, (None, _short(n), _short(s))


def unpacked(x: tuple, total: int) -> tuple[np.ndarray, np.ndarray]:
    if x[0] is None:
        return x[1].astype(np.float64), x[2].astype(np.float64)
    n, s = np.zeros(total), np.zeros(total)
    n[x[0]], s[x[0]] = x[1], x[2]
    return n, s


def level_splits(frame: BinnedFrame, counts_of: Callable, least: float) -> dict:
    """(best split or None, rows, sum) of every key: ``counts_of(block)`` yields (key, rows by bin, sums by bin).

    One job: counts are added in the map tasks first, then by key.
    """
    offset, size, total = frame.offset, frame.size, frame.total

    def count(blocks):
        yield from packed((x for b in blocks for x in counts_of(b)), total)

    def add(a, b):
        (n, s), (m, t) = unpacked(a, total), unpacked(b, total)
        return None, n + m, s + t

    def best(x):
        n, s = unpacked(x, total)
        return best_split(n, s, offset, size, least), float(n[:size[0]].sum()), float(s[:size[0]].sum())

    return dict(frame.rdd.mapPartitions(count).reduceByKey(add, frame.meet).mapValues(best).collect())


# workers get these functions with the job, so the package needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

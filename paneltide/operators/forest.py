"""Random forests grown to purity, in two phases (M7).

``pyspark.ml`` grows a forest level by level over the whole cluster and keeps it
on the driver, which ends at 30 levels and ships forests of many MB with
every task.  Here the upper levels of all trees are grown together by histograms
(trees.py) until a node has at most ``local_rows`` rows.  Then the rows of each such
node meet in one task, which finishes its subtree down to equal targets.  Subtrees stay
a table: predictions route the rows through the small tops, meet the subtrees by (target, tree,
node), and average by row.  Nothing that grows with the rows is held on the driver or sent
with a job.

Bagging: a row counts Poisson(1) times in a tree, drawn from a hash of (seed, tree,
row), so a task that runs again draws the same.  A node whose rows can't be told apart is a leaf in
either phase.  Features have at most 255 bins.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .trees import MAX_BINS, TIE, BinnedFrame, Tree, level_splits, slot_counts, to_blocks, walk

LOCAL_ROWS = 32_768
#: Trees (times targets) whose rows are dealt at once; bounds the shuffle to so many copies of the rows.
WAVE = 50
#: Row copies that may always be dealt at once, so that small frames need few waves.
COPIES = 20_000_000
#: A feature is counted by (node, bin) as long as these are at most so many times the rows, else sorted.
GRID = 1
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bag(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row counts in a tree."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1342543DE82EF95) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_CDF, (x >> np.uint64(11)).astype(np.float64) / 2**53).astype(np.float64)


def _counted_splits(at: np.ndarray, w: np.ndarray, wy: np.ndarray, total_w: np.ndarray, total_s: np.ndarray, width: int, best: np.ndarray) -> tuple:
    """(node, cut, gain) where a feature beats ``best``; ``at`` is node * width + bin of each row."""
    shape = (len(best), width)
    held = np.bincount(at, w, len(best) * width).reshape(shape)
    lw, ls = np.cumsum(held, 1), np.cumsum(np.bincount(at, wy, len(best) * width).reshape(shape), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((held > 0) & (lw < total_w[:, None]), ls**2 / lw + (total_s[:, None] - ls) ** 2 / (total_w[:, None] - lw), -1.0)
    top = gain.max(1)
    names = np.flatnonzero(top > best * (1 + TIE) + 1e-300)  # an earlier feature wins a tie
    cuts = np.argmax(gain[names] >= (top[names] * (1 - TIE))[:, None], 1)
    return names, cuts, gain[names, cuts]


def _sorted_splits(o: np.ndarray, node: np.ndarray, column: np.ndarray, w: np.ndarray, wy: np.ndarray, total_w: np.ndarray, total_s: np.ndarray, starts: np.ndarray, best: np.ndarray) -> tuple:
    """The same from the rows by node and bin."""
    nothing = np.zeros(0, np.int64)
    r, b = node[o], column[o]
    at = np.flatnonzero((r[:-1] == r[1:]) & (b[:-1] != b[1:]))
    if not len(at):
        return nothing, nothing, np.zeros(0)
    cw, cs = np.cumsum(w[o]), np.cumsum(wy[o])
    before = starts - 1
    base_w, base_s = np.where(before >= 0, cw[before], 0.0), np.where(before >= 0, cs[before], 0.0)
    ra = r[at]
    lw, ls = cw[at] - base_w[ra], cs[at] - base_s[ra]
    gain = ls**2 / lw + (total_s[ra] - ls) ** 2 / (total_w[ra] - lw)
    own = np.flatnonzero(np.concatenate([[True], ra[1:] != ra[:-1]]))
    top = np.maximum.reduceat(gain, own)
    better = top > best[ra[own]] * (1 + TIE) + 1e-300
    if not better.any():
        return nothing, nothing, np.zeros(0)
    full = np.repeat(np.where(better, top * (1 - TIE), np.inf), np.diff(np.append(own, len(ra))))
    hit = np.flatnonzero(gain >= full)
    names, first = np.unique(ra[hit], return_index=True)
    return names, b[at[hit[first]]], gain[hit[first]]


def finish(bins: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int | None = None) -> tuple[np.ndarray, ...]:
    """A regression tree over these rows, grown level by level until targets are equal: feature, cut, left, right, value."""
    columns = np.ascontiguousarray(bins.T)
    width = columns.max(1).astype(int) + 1
    wy = w * y
    rows, rank = np.arange(len(y)), np.zeros(len(y), np.int64)  # the open rows by node, and their node's rank in the level
    node = np.zeros(len(y), np.int64)  # of all rows: that rank, or -1
    order: list = [None] * len(columns)  # the open rows by node and bin, for features that are sorted
    level = np.zeros(1, np.int64)  # numbers of the level's nodes
    made, depth = 1, 0
    feature_of, cut_of, left_of, value_of = {}, {}, {}, {}
    while len(level):
        starts = np.searchsorted(rank, np.arange(len(level)))
        w_of, wy_of, y_of = w[rows], wy[rows], y[rows]
        total_w, total_s = np.add.reduceat(w_of, starts), np.add.reduceat(wy_of, starts)
        value_of.update(zip(level.tolist(), (total_s / total_w).tolist(), strict=True))
        mixed = np.maximum.reduceat(y_of, starts) > np.minimum.reduceat(y_of, starts)
        best = np.where(mixed, total_s**2 / total_w, np.inf)
        feature, cut = np.full(len(level), -1), np.zeros(len(level), np.int64)
        if max_depth is None or depth < max_depth:
            for f, column in enumerate(columns):
                if width[f] == 1:
                    continue
                if len(level) * width[f] <= GRID * len(rows):  # few bins for the rows: count instead of sorting
                    order[f] = None
                    names, cuts, gains = _counted_splits(rank * width[f] + column[rows], w_of, wy_of, total_w, total_s, int(width[f]), best)
                else:
                    if order[f] is None:
                        order[f] = rows[np.argsort(rank * 256 + column[rows], kind="stable")]
                    names, cuts, gains = _sorted_splits(order[f], node, column, w, wy, total_w, total_s, starts, best)
                best[names], feature[names], cut[names] = gains, f, cuts
        split = np.flatnonzero(feature >= 0)
        left = made + 2 * np.arange(len(split))
        for k, n in zip(split.tolist(), left.tolist(), strict=True):
            feature_of[int(level[k])], cut_of[int(level[k])], left_of[int(level[k])] = int(feature[k]), int(cut[k]), n
        new = np.full(len(level), -1)
        new[split] = 2 * np.arange(len(split))
        goes_right = columns[feature[rank], rows] > cut[rank]
        moved = np.where(new[rank] >= 0, new[rank] + goes_right, -1)
        node[rows] = moved
        kind = np.int16 if 2 * len(split) < 2**15 else np.int64  # few ranks sort faster
        rows, rank = rows[moved >= 0], moved[moved >= 0]
        by_rank = np.argsort(rank.astype(kind), kind="stable")
        rows, rank = rows[by_rank], rank[by_rank]
        for f, o in enumerate(order):
            if o is not None:
                o = o[node[o] >= 0]
                order[f] = o[np.argsort(node[o].astype(kind), kind="stable")]
        level = np.stack([left, left + 1], 1).ravel()
        made += 2 * len(split)
        depth += 1
    get = lambda d, default: np.array([d.get(i, default) for i in range(made)])
    left = get(left_of, -1)
    return get(feature_of, -1), get(cut_of, 0), left, np.where(left >= 0, left + 1, -1), get(value_of, 0.0)


_TREE = "target int, tree int, node int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"


def _deal(tops: dict, labels: int, small: dict, seed: int | None):
    """Rows of the blocks by (target, tree, node): bins, targets and weights of each in one row (without ``seed``: bins and row numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                bins = np.frombuffer(r["bins"], np.uint8).reshape(len(ids), -1)
                y = np.frombuffer(r["y"]).reshape(len(ids), labels) if seed is not None else None
                for (j, t), top in tops.items():
                    at = walk(top, bins, binned=True)
                    w = bag(ids, seed, t) if seed is not None else np.ones(len(ids))
                    rows = []
                    for node in np.unique(at).tolist():
                        own = np.flatnonzero((at == node) & (w > 0))
                        if len(own) and (seed is None or (j, t, node) in small):
                            rows.append((j, t, node, bins[own].tobytes(), (y[own, j] if seed is not None else ids[own]).tobytes(), w[own].tobytes()))
                    if rows:
                        c = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in c[:3]], *[pa.array(x, pa.binary()) for x in c[3:]]], ["target", "tree", "node", "bins", "y", "w"])

    return run


def _finish(width: int, max_depth: int | None, tops_depth: dict):
    def run(group: pa.Table) -> pa.Table:
        join = lambda c: b"".join(group.column(c).to_pylist())
        key = tuple(group.column(c)[0].as_py() for c in ("target", "tree", "node"))
        y, w = np.frombuffer(join("y")), np.frombuffer(join("w"))
        bins = np.frombuffer(join("bins"), np.uint8).reshape(len(y), width)
        grown = finish(bins, y, w, None if max_depth is None else max_depth - tops_depth.get(key, 0))
        return pa.table({**{c: pa.array([k], pa.int32()) for c, k in zip(("target", "tree", "node"), key, strict=True)},
                         **{c: pa.array([x], pa.list_(pa.float64() if c == "value" else pa.int32())) for c, x in zip(("feature", "cut", "left", "right", "value"), grown, strict=True)}})

    return run


@dataclass
class ForestModel:
    """Tops of the trees (small) and a stored table of the subtrees below them."""

    labels: list
    edges: list
    tops: dict  # (target, tree) -> arrays
    subtrees: DataFrame

    def transform(self, df: DataFrame, features: str, prefix: str = "prediction_", part_rows: int = 100_000) -> DataFrame:
        """``df`` with a column ``prefix + label`` for each target.  Rows of null features get nulls."""
        kept = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        rows = kept.where(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"), F.array().cast("array<double>").alias("y"), "_row")
        blocks = rows.mapInArrow(to_blocks(self.edges, 0), "bins binary, y binary, ids binary")
        parts = max(1, math.ceil(kept.count() / part_rows))
        dealt = blocks.mapInArrow(_deal(self.tops, 0, {}, None), "target int, tree int, node int, bins binary, y binary, w binary").withColumn("part", F.pmod(F.xxhash64("y"), F.lit(parts)).cast("int"))
        trees = self.subtrees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["target", "tree", "node", "part"]
        each = dealt.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(_predict(len(self.edges)), "_row long, target int, value double")
        mean = each.groupBy("_row").agg(*[F.avg(F.when(F.col("target") == j, F.col("value"))).alias(prefix + label) for j, label in enumerate(self.labels)])
        return kept.join(mean, "_row", "left").drop("_row")


def _predict(width: int):
    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        ids, out = [], []
        if trees.num_rows:
            tree = trees.slice(0, 1).to_pylist()[0]
            cut = np.array(tree["cut"])
            arrays = (np.array(tree["feature"]), cut, cut, np.array(tree["left"]), np.array(tree["right"]), np.array(tree["value"]))
            for bins, y in zip(rows.column("bins").to_pylist(), rows.column("y").to_pylist(), strict=True):
                own = np.frombuffer(bins, np.uint8).reshape(-1, width)
                ids.append(np.frombuffer(y, np.int64))
                out.append(arrays[5][walk(arrays, own, binned=True)])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        target = rows.column("target")[0].as_py() if rows.num_rows else 0
        return pa.table({"_row": pa.array(ids), "target": pa.array(np.full(len(ids), target, np.int32)), "value": pa.array(np.concatenate(out) if out else np.zeros(0))})

    return run


def _tops(frame: BinnedFrame, trees: Sequence[tuple[int, int]], seed: int, local_rows: int, max_depth: int | None) -> tuple[dict, dict, dict]:
    """The upper levels of these (target, tree): arrays, the nodes to be finished with their depth, the values of nodes that are leaves."""
    grown = {k: Tree() for k in trees}
    small: dict = {}
    leaves: dict = {}
    open_nodes = {k: [0] for k in trees} if frame.rows > local_rows else {}
    if not open_nodes:
        small = {(*k, 0): 0 for k in trees}
    depth = 0
    while open_nodes:
        arrays = {k: grown[k].arrays() for k in open_nodes}

        def rows_of(b, arrays=arrays, open_nodes=open_nodes):
            for (j, t), nodes in open_nodes.items():
                slot = np.full(len(arrays[j, t][0]), -1)
                slot[nodes] = np.arange(len(nodes))
                w = bag(b.ids, seed, t)
                at = np.where(w > 0, slot[walk(arrays[j, t], b.bins, binned=True)], -1)
                yield [(j, t, n) for n in nodes], at, w, b.y[:, j]

        found = level_splits(frame, slot_counts(frame, rows_of), 0)
        nodes, open_nodes = open_nodes, {}
        depth += 1
        for k, own in nodes.items():
            for node in own:
                split, n, s = found.get((*k, node), (None, 0.0, 0.0))
                if split is None or (max_depth is not None and depth > max_depth):
                    leaves[(*k, node)] = s / n if n else 0.0
                    continue
                _, feature, cut, left_n, _, n, _ = split
                for child, rows in zip(grown[k].split(node, feature, cut, frame.threshold(feature, cut)), (left_n, n - left_n), strict=True):
                    if rows > local_rows:
                        open_nodes.setdefault(k, []).append(child)
                    else:
                        small[(*k, child)] = depth
    return {k: t.arrays() for k, t in grown.items()}, small, leaves


def fit_forest(train: DataFrame, features: str, labels: Sequence[str], n_trees: int = 100, seed: int = 42, max_depth: int | None = None,
               local_rows: int = LOCAL_ROWS, wave: int | None = None, max_bins: int = MAX_BINS) -> ForestModel:
    """A forest of ``n_trees`` for each label over one binned frame; the trees of all labels share their bags.

    Rows with a null label take no part; no rows raise ValueError.
    """
    spark = train.sparkSession
    labels = list(labels)
    frame = BinnedFrame(train, features, labels, max_bins)
    wave = wave or max(WAVE, COPIES // frame.rows)
    wanted = [(j, t) for t in range(n_trees) for j in range(len(labels))]
    tops: dict = {}
    tables: list[DataFrame] = []
    for a in range(0, len(wanted), wave):
        top, small, leaves = _tops(frame, wanted[a:a + wave], seed, local_rows, max_depth)
        tops |= top
        dealt = frame.table.mapInArrow(_deal(top, len(labels), small, seed), "target int, tree int, node int, bins binary, y binary, w binary")
        tables.append(cut_lineage(dealt.groupBy("target", "tree", "node").applyInArrow(_finish(len(frame.edges), max_depth, small), _TREE)))
        if leaves:
            tables.append(spark.createDataFrame([(*k, [-1], [0], [-1], [-1], [float(v)]) for k, v in leaves.items()], _TREE))
    frame.free()
    subtrees = tables[0]
    for t in tables[1:]:
        subtrees = subtrees.unionByName(t)
    return ForestModel(labels, frame.edges, tops, subtrees)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Gradient boosting on Spark for quantiles (M6) and means (M5, M8).

``pyspark.ml`` has no quantile (pinball) loss and no limit of leaves.  The boosting loop here, for a quantile:

* F0 = the alpha-quantile of the target;
* each round grows a regression tree on the negative pinball gradient
  ``alpha - 1{y < F}`` (each row counts by its bin; trees.py), then every leaf's
  output is the alpha-quantile of the residuals ``y - F`` of its rows, from mergeable
  sketches (exact up to ``trees.SKETCH`` different residuals a leaf);
* F += learning_rate * leaf value.

For a mean (``alpha=None``) F0 is the mean, trees grow on the residuals, and a leaf's output is their mean.

The frame is binned once.  All levels of all models (several alphas, several
targets) are grown together: one job a level and one for the leaves, whatever
the number of models.  Rows carry F: each round stores its rows anew, so no tree is
walked again.  Every ``checkpoint_every`` rounds they are written to the
reliable checkpoint folder, so lineage stays short and a lost executor
replays at most that many rounds.  Thousands of jobs are worth it only where the
rows are many: a frame of at most ``LOCAL_ROWS`` rows goes to one task a model, which
runs the same rounds there.  Both give the same trees (a test compares them).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .models import FEATURES, leaves_to_depth
from .trees import MAX_BINS, BinnedFrame, Block, Tree, add_outputs, best_split, counted, counted_flags, counted_slots, divide, merge_sketches, packed, places, sketch, sketch_quantile, unpacked

ALPHAS = (0.1, 0.5, 0.9)
#: Rows of a frame up to which a model's rounds run in one task: some 25 MB of bins.
LOCAL_ROWS = 400_000
#: Rows that a task of larger frames works on at once.
STATE_ROWS = 131_072


@dataclass
class QuantileBoostModel:
    """One quantile (``alpha=None``: the mean) of one target; leaf values hold the learning rate."""

    alpha: float | None
    init: float
    learning_rate: float
    label: str = ""
    trees: list = field(default_factory=list)  # arrays of trees.Tree

    def transform(self, df: DataFrame, output: str = "prediction", features: str = FEATURES) -> DataFrame:
        return predict_columns(df, {output: self}, features)

    def save(self, spark: SparkSession, path: str) -> None:
        """As a Parquet table: one row per node, and one that describes the model."""
        save_models(spark, {"model": self}, path)


def predict_columns(df: DataFrame, models: dict[str, QuantileBoostModel], features: str = FEATURES) -> DataFrame:
    """``df`` with one column per model, in one pass over the rows.  A row of null features gets nulls."""
    names = list(models)
    held = df.sparkSession.sparkContext.broadcast([(m.init, m.trees) for m in models.values()])  # rounds x leaves x models, whatever the rows

    schema = ", ".join(f"p{k} double" for k in range(len(names)))

    @F.pandas_udf(schema)
    def predict(xs: pd.Series) -> pd.DataFrame:
        known = xs.notna().to_numpy()
        out = np.full((len(xs), len(names)), np.nan)
        if known.any():
            x = np.ascontiguousarray(np.stack(xs[known].to_list()).T)
            for k, (init, trees) in enumerate(held.value):
                own = np.zeros(x.shape[1])
                for tree in trees:
                    add_outputs(x, tree, own, binned=False)
                out[known, k] = init + own
        return pd.DataFrame({f"p{k}": out[:, k] for k in range(len(names))})

    out = df.withColumn("_predicted", predict(F.when(F.col(features).isNotNull(), vector_to_array(features))))
    return out.select(*df.columns, *[F.when(~F.isnan(F.col(f"_predicted.p{k}")), F.col(f"_predicted.p{k}")).alias(n) for k, n in enumerate(names)])


# ---- fitting

@dataclass
class _State:
    """Rows with the predictions of all models so far."""

    columns: np.ndarray  # bins: features x rows
    y: np.ndarray  # labels x rows
    f: np.ndarray  # models x rows


def _states(blocks: Iterator[Block], init: list) -> Iterator[_State]:
    """Blocks joined up to ``STATE_ROWS`` rows."""
    held: list[Block] = []

    def joined() -> _State:
        y = np.ascontiguousarray(np.concatenate([b.y for b in held]).T)
        return _State(np.ascontiguousarray(np.concatenate([b.bins for b in held]).T), y, np.repeat(np.array(init, float)[:, None], y.shape[1], 1))

    for b in blocks:
        if held and sum(len(h.bins) for h in held) + len(b.bins) > STATE_ROWS:
            yield joined()
            held = []
        held.append(b)
    if held:
        yield joined()


def _moved(b: _State, trees: list) -> _State:
    f = b.f.copy()
    for k, tree in enumerate(trees):
        add_outputs(b.columns, tree, f[k], binned=True)
    return _State(b.columns, b.y, f)


@dataclass
class _Rounds:
    """How a round's trees grow, whatever counts the rows; one entry a model."""

    rates: list[float]
    num_leaves: list[int]
    depths: list[int]
    least: int
    edges: list
    first: float | None = None  # the rate of the first round, if another

    def only(self, k: int) -> _Rounds:
        return _Rounds([self.rates[k]], [self.num_leaves[k]], [self.depths[k]], self.least, self.edges, self.first)

    def allowed(self, found: dict, model: int, leaves: int) -> list:
        """The splits of a level with the highest gains, as many as leaves are left."""
        own = sorted(((split[0], node, split) for (k, node), (split, _, _) in found.items() if k == model and split), key=lambda x: (-x[0], x[1]))
        return own[:max(0, self.num_leaves[model] - leaves)]

    def grow(self, m: int, splits_of, outputs_of) -> list[tuple]:
        """Round ``m``: one tree a model.  ``splits_of(trees, open nodes)`` gives the best split of every open node, ``outputs_of(trees)`` every leaf's output."""
        grown = [Tree() for _ in self.rates]
        open_nodes: list[list[int]] = [[0] for _ in self.rates]
        for level in range(max(self.depths)):
            open_nodes = [own if level < depth else [] for own, depth in zip(open_nodes, self.depths, strict=True)]
            if not any(open_nodes):
                break
            found = splits_of([t.arrays() for t in grown], open_nodes)
            open_nodes = [[] for _ in self.rates]
            for k, tree in enumerate(grown):
                leaves = sum(x < 0 for x in tree.feature)
                for _, node, (_, feature, cut, left_n, _, n, _) in self.allowed(found, k, leaves):
                    for child, rows in zip(tree.split(node, feature, cut, float(self.edges[feature][cut])), (left_n, n - left_n), strict=True):
                        if rows >= 2 * self.least:
                            open_nodes[k].append(child)
        for (k, leaf), v in outputs_of([t.arrays() for t in grown]):
            grown[k].value[leaf] = (self.rates[k] if m or self.first is None else self.first) * v
        return [t.arrays() for t in grown]


def _gradient(y: np.ndarray, f: np.ndarray, alpha: float | None) -> np.ndarray:
    """What a split sums up.  A quantile's gradient is alpha less what is summed here: a constant doesn't move the best split."""
    return y - f if alpha is None else y < f


def _open_counts(layout: tuple, target: Sequence[int], alphas: Sequence[float | None], arrays: list, open_nodes: list):
    """For ``trees.packed``: the counts of the open nodes' rows; at the roots, three quantiles in one pass."""
    offset, size, total = layout

    def run(b: _State):
        values = {k: _gradient(b.y[target[k]], b.f[k], alphas[k]) for k, nodes in enumerate(open_nodes) if nodes}
        roots = [k for k in values if len(arrays[k][0]) == 1 and alphas[k] is not None]
        for a in range(0, len(roots), 3):
            count, sums = counted_flags(b.columns, [values.pop(k) for k in roots[a:a + 3]], offset, size, total)
            for k, own in zip(roots[a:a + 3], sums, strict=True):
                yield (k, 0), count.copy(), own
        for k, value in values.items():
            slots = np.full(len(arrays[k][0]), -1)
            slots[open_nodes[k]] = np.arange(len(open_nodes[k]))
            slot = slots.take(places(b.columns, arrays[k], binned=True))
            rows = np.flatnonzero(slot >= 0)
            slot = slot.take(rows)
            order = np.argsort(slot.astype(np.uint16) if len(slots) <= 1 << 16 else slot, kind="stable")  # a slot's counts stay near
            rows, slot = rows.take(order), slot.take(order)
            held = np.bincount(slot, minlength=len(open_nodes[k]))
            for node, n, *sums in zip(open_nodes[k], held, *counted_slots(b.columns, rows, slot, len(open_nodes[k]), value, offset, size, total), strict=True):
                if n:
                    yield (k, node), *sums

    return run


def _summary(values: np.ndarray, alpha: float | None) -> tuple:
    """What a mean (sum and rows) or a quantile (a sketch) is worked out from."""
    return (None, values.sum(), len(values)) if alpha is None else sketch(values)


def _merge(a: tuple, b: tuple) -> tuple:
    return (None, a[1] + b[1], a[2] + b[2]) if a[0] is None else merge_sketches(a, b)


def _statistic(summary: tuple, alpha: float | None) -> float:
    return float(summary[1] / summary[2]) if alpha is None else sketch_quantile(*summary, alpha)


def _leaf_residuals(blocks: Iterator[_State], target: Sequence[int], alphas: Sequence[float | None], arrays: list):
    """((model, leaf), summary) of a task's rows; a leaf's residuals are gathered from all blocks and sorted once."""
    held: dict = {}
    for b in blocks:
        for k, tree in enumerate(arrays):
            at = places(b.columns, tree, binned=True)
            order = np.argsort(at.astype(np.uint16) if len(tree[0]) <= 1 << 16 else at, kind="stable")
            r = (b.y[target[k]] - b.f[k]).take(order)
            stop = np.cumsum(np.bincount(at, minlength=len(tree[0])))
            for leaf, rows in enumerate(np.split(r, stop[:-1])):
                if len(rows):
                    held.setdefault((k, leaf), []).append(rows)
    for (k, leaf), parts in held.items():
        yield (k, leaf), _summary(np.concatenate(parts), alphas[k])


def fit_boosts(train: DataFrame, wanted: Sequence[tuple[str, float | None]], n_rounds: int = 200, learning_rate: float = 0.1,
               num_leaves: int = 50, max_depth: int = -1, min_rows_per_leaf: int = 20, max_bins: int = MAX_BINS,
               checkpoint_every: int = 20, local_rows: int = LOCAL_ROWS) -> list[QuantileBoostModel]:
    """One model for each (label, alpha) of ``wanted``; alpha None is the mean.

    ``train`` needs the ``features`` vector column; rows with a null label or no features take no part; no rows raise ValueError.
    Trees have at most ``num_leaves`` leaves and ``leaves_to_depth`` levels; of a level, the splits of the highest gain come first.
    """
    ensure_checkpoint_dir(train.sparkSession)
    labels = list(dict.fromkeys(label for label, _ in wanted))
    target = [labels.index(label) for label, _ in wanted]
    alphas = [a for _, a in wanted]
    frame = BinnedFrame(train, FEATURES, labels, max_bins)

    def first(blocks):
        for b in blocks:
            for k, a in enumerate(alphas):
                yield k, _summary(b.y[:, target[k]], a)

    start = dict(frame.rdd.mapPartitions(first).reduceByKey(_merge, frame.meet).collect())
    init = [_statistic(start[k], a) for k, a in enumerate(alphas)]
    n = len(wanted)
    rounds = _Rounds([learning_rate] * n, [num_leaves] * n, [leaves_to_depth(num_leaves, max_depth)] * n, min_rows_per_leaf, frame.edges)
    trees = _fit(frame, rounds, target, alphas, init, n_rounds, checkpoint_every, local_rows)
    frame.free()
    return [QuantileBoostModel(a, f0, learning_rate, label, own) for (label, a), f0, own in zip(wanted, init, trees, strict=True)]


def _fit(frame: BinnedFrame, rounds: _Rounds, target: list, alphas: list, init: list, n_rounds: int, checkpoint_every: int = 20, local_rows: int = LOCAL_ROWS) -> list[list]:
    if frame.rows <= local_rows:
        return _fit_where_rows_meet(frame, rounds, target, alphas, init, n_rounds)
    return _fit_in_step(frame, rounds, target, alphas, init, n_rounds, checkpoint_every)


class _Here:
    """One tree on rows at hand: each node's rows and counts.  Of two children, the one of fewer rows is counted; the other's counts are its parent's less these."""

    def __init__(self, b: _State, value: np.ndarray, layout: tuple, least: int) -> None:
        self.b, self.value, self.layout, self.least = b, value, layout, least
        self.rows = {0: np.arange(b.columns.shape[1])}
        self.counts: dict = {}

    def splits_of(self, arrays: list, open_nodes: list) -> dict:
        pairs = self.divide(arrays[0])
        wanted = set(open_nodes[0])
        fewer = [min((left, right), key=lambda n: len(self.rows[n])) for _, left, right in pairs if left in wanted or right in wanted]
        if not self.counts:
            fewer = [0]
        old, self.counts = self.counts, {}
        if fewer:
            self.counts = dict(zip(fewer, zip(*counted(self.b.columns, [self.rows[n] for n in fewer], self.value, *self.layout), strict=True), strict=True))
        for parent, left, right in pairs:
            for one, other in ((left, right), (right, left)):
                if one in wanted and one not in self.counts:
                    self.counts[one] = (old[parent][0] - self.counts[other][0], old[parent][1] - self.counts[other][1])
        return {(0, n): (best_split(*self.counts[n], *self.layout[:2], self.least), 0, 0) for n in open_nodes[0]}

    def divide(self, tree: tuple) -> list[tuple[int, int, int]]:
        """Rows of new splits go to the children; (parent, left, right) of these."""
        feature, cut, _, left, right, _ = tree
        new = [n for n in self.rows if feature[n] >= 0]
        for n in new:
            self.rows[int(left[n])], self.rows[int(right[n])] = divide(self.b.columns, self.rows.pop(n), feature[n], cut[n])
        return [(n, int(left[n]), int(right[n])) for n in new]


def _fit_where_rows_meet(frame: BinnedFrame, rounds: _Rounds, target: list, alphas: list, init: list, n_rounds: int) -> list[list]:
    """Few rows: each model's rounds run in one task, the models side by side."""
    layout = frame.layout

    def run(blocks):
        by_model: dict = {}
        for k, b in blocks:
            by_model.setdefault(k, []).append(b)
        for k, own in by_model.items():
            own.sort(key=lambda b: int(b.ids[0]))
            y = np.concatenate([b.y[:, target[k]] for b in own])
            b = _State(np.ascontiguousarray(np.concatenate([x.bins for x in own]).T), y[None], np.full((1, len(y)), init[k]))
            alone, trees = rounds.only(k), []
            for m in range(n_rounds):
                here = _Here(b, _gradient(y, b.f[0], alphas[k]), layout, rounds.least)

                def outputs_of(arrays, b=b, y=y, here=here, alpha=alphas[k]):
                    here.divide(arrays[0])
                    r = y - b.f[0]
                    return [((0, leaf), _statistic(_summary(r[rows], alpha), alpha)) for leaf, rows in here.rows.items()]

                trees += alone.grow(m, here.splits_of, outputs_of)
                for leaf, rows in here.rows.items():
                    b.f[0][rows] += trees[-1][5][leaf]
            yield k, trees

    sent = frame.rdd.flatMap(lambda b: [(k, b) for k in range(len(alphas))]).partitionBy(len(alphas), lambda k: k)
    found = dict(sent.mapPartitions(run).collect())
    return [found[k] for k in range(len(alphas))]


class _Levels:
    """One round's trees on the rows of all tasks, a job a level.  As in ``_Here``, of two children the one of fewer rows is
    counted; the other's counts follow where the parent's are held: one partition a model, persisted until the next level."""

    def __init__(self, frame: BinnedFrame, target: list, alphas: list, least: int) -> None:
        self.frame, self.target, self.alphas, self.least = frame, target, alphas, least
        self.held: RDD | None = None
        self.found: dict = {}

    def splits_of(self, arrays: list, open_nodes: list) -> dict:
        layout, least, (offset, size, total) = self.frame.layout, self.least, self.frame.layout
        fewer, pairs = open_nodes, [[] for _ in arrays]
        if self.held is not None:
            fewer = [[] for _ in arrays]
            for (k, parent), (split, _, _) in self.found.items():
                left, right = int(arrays[k][3][parent]), int(arrays[k][4][parent])
                if left in open_nodes[k] or right in open_nodes[k]:
                    one, other = (left, right) if split[3] * 2 <= split[5] else (right, left)
                    fewer[k].append(one)
                    pairs[k].append((parent, one, other))
        counts_of = _open_counts(layout, self.target, self.alphas, arrays, fewer)

        def count(blocks):
            for (k, node), x in packed((x for b in blocks for x in counts_of(b)), total):
                yield k, (node, x)

        def meet(k, sent):
            counts: dict = {}
            for _, (node, x) in sent:
                n, s = unpacked(x, total)
                if node in counts:
                    counts[node][0] += n
                    counts[node][1] += s
                else:
                    counts[node] = [n, s]
            yield k, counts

        def derive(x):
            (k, counts), (_, old) = x
            out = {}
            for parent, one, other in pairs[k]:
                for node, c in ((one, counts[one]), (other, [old[parent][0] - counts[one][0], old[parent][1] - counts[one][1]])):
                    if node in open_nodes[k]:
                        out[node] = c
            return k, out

        def best(x):
            k, counts = x
            return [((k, node), (best_split(n, s, offset, size, least), 0, 0)) for node, (n, s) in counts.items()]

        before = self.held
        level = self.frame.rdd.mapPartitions(count).partitionBy(len(arrays), lambda k: k).mapPartitionsWithIndex(meet)
        self.held = (level if before is None else level.zip(before).map(derive)).persist(StorageLevel.MEMORY_AND_DISK)
        self.found = dict(self.held.flatMap(best).collect())
        if before is not None:
            before.unpersist()
        found, self.found = self.found, {key: x for key, x in self.found.items() if x[0]}
        return found

    def free(self) -> None:
        if self.held is not None:
            self.held.unpersist()


def _fit_in_step(frame: BinnedFrame, rounds: _Rounds, target: list, alphas: list, init: list, n_rounds: int, checkpoint_every: int) -> list[list]:
    """All models grow together: one job a level and one for the leaves, whatever the number of models."""
    whole = frame.rdd
    # every task sends counts of all open nodes and bins, so no more tasks than the rows need and the cores take
    parts = min(whole.getNumPartitions(), max(1, frame.rows * 2 // STATE_ROWS), 2 * whole.context.defaultParallelism)
    frame.meet = min(frame.meet, parts)
    frame.rdd = whole.coalesce(parts).mapPartitions(lambda blocks: _states(blocks, init)).persist(StorageLevel.MEMORY_AND_DISK)
    frame.rdd.checkpoint()  # to the shared folder: short lineage, nothing is lost with an executor
    frame.rdd.count()
    whole.unpersist()
    trees: list[list] = [[] for _ in alphas]
    before: RDD | None = None
    for m in range(n_rounds):
        levels = _Levels(frame, target, alphas, rounds.least)

        def outputs_of(arrays, state=frame.rdd):
            found = state.mapPartitions(lambda blocks: _leaf_residuals(blocks, target, alphas, arrays))
            return found.reduceByKey(_merge, frame.meet).map(lambda x: (x[0], _statistic(x[1], alphas[x[0][0]]))).collect()

        new = rounds.grow(m, levels.splits_of, outputs_of)
        levels.free()
        if before is not None:
            before.unpersist()  # this round's jobs have stored its successor
        for k, tree in enumerate(new):
            trees[k].append(tree)
        if m + 1 < n_rounds:
            before = frame.rdd
            frame.rdd = before.map(lambda b, new=new: _moved(b, new)).persist(StorageLevel.MEMORY_AND_DISK)
            if (m + 1) % checkpoint_every == 0:
                frame.rdd.checkpoint()
    return trees


def staged_errors(train: DataFrame, held_out: DataFrame, label: str, fits: Sequence[tuple[float, int]], n_rounds: int,
                  max_bins: int = MAX_BINS, checkpoint_every: int = 20, local_rows: int = LOCAL_ROWS) -> list[list[float]]:
    """For each (rate, depth) of ``fits``: the mean squared error on ``held_out`` after each of ``n_rounds`` trees.

    The trees are those of ``pyspark.ml``'s ``GBTRegressor``: from 0, the first tree counts whole, a later one twice the rate (its
    gradient of the squared error), leaves of one row and more.  All fits grow side by side over one binned frame.
    """
    ensure_checkpoint_dir(train.sparkSession)
    frame = BinnedFrame(train, FEATURES, [label], max_bins)
    n = len(fits)
    rounds = _Rounds([2 * rate for rate, _ in fits], [1 << depth for _, depth in fits], [depth for _, depth in fits], 1, frame.edges, first=1.0)
    trees = _fit(frame, rounds, [0] * n, [None] * n, [0.0] * n, n_rounds, checkpoint_every, local_rows)
    frame.free()

    def squared(blocks):
        total, rows = np.zeros((n, n_rounds)), 0
        for b in _states(blocks, [0.0] * n):
            rows += b.y.shape[1]
            for k, grown in enumerate(trees):
                for m, tree in enumerate(grown):
                    add_outputs(b.columns, tree, b.f[k], binned=True)
                    total[k, m] += ((b.y[0] - b.f[k]) ** 2).sum()
        yield total, rows

    total, rows = frame.blocks_of(held_out, FEATURES).mapPartitions(squared).fold((np.zeros((n, n_rounds)), 0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return (total / rows if rows else np.full((n, n_rounds), np.nan)).tolist()


def fit_quantile_boost(train: DataFrame, label: str, alpha: float, **params) -> QuantileBoostModel:
    """Fit one quantile model."""
    return fit_boosts(train, [(label, alpha)], **params)[0]


def fit_quantile_models(train: DataFrame, label: str, alphas: Sequence[float] = ALPHAS, **params) -> dict[float, QuantileBoostModel]:
    """One model per alpha, grown together."""
    return dict(zip(alphas, fit_boosts(train, [(label, a) for a in alphas], **params), strict=True))


def quantile_predictions(models: dict[float, QuantileBoostModel], test: DataFrame, label: str = "total_orders") -> DataFrame:
    """One row per test row and alpha (long); write it with ``partitionBy("alpha")`` for one folder per quantile."""
    keep = [c for c in ("restaurant_id", "date") if c in test.columns] + [label]
    wide = predict_columns(test.select(*keep, FEATURES), {f"_q{k}": m for k, m in enumerate(models.values())})
    each = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_q{k}").alias("prediction")) for k, a in enumerate(models)])
    return wide.select(*keep, F.inline(each))


def quantile_metrics(predictions: DataFrame, label: str = "total_orders") -> DataFrame:
    """E3 of a long table: mean pinball loss and mae per alpha."""
    y = F.col(label).cast("double")
    loss = F.greatest(F.col("alpha") * (y - F.col("prediction")), (F.col("alpha") - 1) * (y - F.col("prediction")))
    return predictions.groupBy("alpha").agg(F.avg(loss).alias("pinball_loss"), F.avg(F.abs(y - F.col("prediction"))).alias("mae"))


def quantile_forecast(train: DataFrame, test: DataFrame, alphas: Sequence[float] = ALPHAS, label: str = "total_orders",
                      **params) -> tuple[DataFrame, DataFrame, dict[float, QuantileBoostModel]]:
    """Fit one model per alpha; return (long predictions, pinball/mae per alpha, models)."""
    models = fit_quantile_models(train, label, alphas, **params)
    long = cut_lineage(quantile_predictions(models, test, label))
    return long, quantile_metrics(long, label), models


# ---- saving

_NODES = "name string, tree int, node int, feature int, cut int, threshold double, left int, right int, value double, about string"


def save_models(spark: SparkSession, models: dict[str, QuantileBoostModel], path: str) -> None:
    """S8 for quantile models: one Parquet table for all of ``models``."""
    rows = []
    for name, m in models.items():
        about = {"alpha": m.alpha, "init": m.init, "learning_rate": m.learning_rate, "label": m.label}
        rows.append((name, -1, 0, None, None, None, None, None, None, json.dumps(about)))
        for k, tree in enumerate(m.trees):
            rows += [(name, k, i, *[c.item() for c in node], None) for i, node in enumerate(zip(*tree, strict=True))]
    spark.createDataFrame(rows, _NODES).coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[str, QuantileBoostModel]:
    """The models of ``save_models``; a table holds rounds x leaves nodes a model, whatever the training rows."""
    nodes = spark.read.schema(_NODES).parquet(path).toPandas().sort_values(["name", "tree", "node"])
    out = {}
    for name, own in nodes.groupby("name"):
        m = QuantileBoostModel(**json.loads(own["about"].iloc[0]))
        for _, t in own[own["tree"] >= 0].groupby("tree"):
            m.trees.append((*[t[c].to_numpy().astype(int) for c in ("feature", "cut")], t["threshold"].to_numpy(), *[t[c].to_numpy().astype(int) for c in ("left", "right")], t["value"].to_numpy()))
        out[name] = m
    return out


def pinball(y: Column, q: Column, alpha: float) -> Column:
    d = y - q
    return F.greatest(F.lit(alpha) * d, F.lit(alpha - 1.0) * d)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

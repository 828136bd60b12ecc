"""Hard negatives by shared lists of clustered anchors (MAXIMUS).

Scores are integer inner products.  Anchors of a similar direction form a
cluster.  For a cluster, every candidate has an upper bound: its length times the
cosine of its angle to the centre, less the widest angle between the centre and a
member.  Candidates are sorted by it once; every member walks this list from
the top and stops as soon as its own length times the next bound can't reach
its worst kept row, so the result is exact.

Dealing: candidates lie in slices of about ``SLICE`` rows, anchors in blocks of at most
about ``BLOCK`` (whole clusters, large ones cut), and each (block, slice) is a task with its
own lists.  Every anchor meets every slice, which the search asks for; a task's
rows are bounded, whatever label, id or group of copies is frequent.  The best rows of the slices
are merged by a rank.  One pass finds the positives; the second walks the lists
again for the score range that each positive opens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SLICE, BLOCK = 16_384, 4_096
#: Anchors that the cluster centres are fitted on (the smallest hashes of all); every anchor is assigned.
SAMPLE, CLUSTERS = 8_192, 64
#: Candidates of a list whose scores are worked out at once.
STEP = 512
_VECTOR = "uid long, vec_id long, label int, v array<long>"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``uid``, ``vec_id``, ``label``, ``v`` (floor(256 x)) of the rows that take part, as a stored table.

    Rows with a null label, a null vector or a null or non-finite component are left out.
    """
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("label").isNotNull() & F.col("e").isNotNull() & ~bad)
    return stage(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(256.0))).alias("v")), "vectors")


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of equal width; missing components of shorter vectors count as 0."""
    rows = column.combine_chunks()
    n = np.diff(rows.offsets.to_numpy()).astype(np.int64)
    width = max(width, int(n.max(initial=0)))
    out = np.zeros((len(n), width), np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length > 0, length, 1)[:, None], length


def _centres(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from evenly spaced starts."""
    unit, _ = _unit(vectors)
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        new, length = _unit(sums)
        centres = np.where(length[:, None] > 0, new, centres)
    return centres


def _assign(centres: np.ndarray):
    def run(batches):
        for b in batches:
            x, _ = _unit(_matrix(pa.chunked_array([b.column("v")]), centres.shape[1]))
            wide = np.zeros((len(centres), x.shape[1]))
            wide[:, :centres.shape[1]] = centres
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array((x @ wide.T).argmax(1).astype(np.int32))], ["uid", "cluster"])

    return run


def cluster_anchors(anchors: DataFrame, block: int = BLOCK, sample: int = SAMPLE, clusters: int = CLUSTERS) -> DataFrame:
    """``anchors`` with ``cluster``, ``centre`` and ``block``; centres are fitted on at most ``sample`` anchors."""
    spark = anchors.sparkSession
    some = anchors.select("v", F.xxhash64("uid").alias("h")).orderBy("h").limit(sample).select("v").toArrow().column("v")
    vectors = _matrix(some)
    centres = _centres(vectors, max(1, min(clusters, len(vectors) // 64))) if vectors.size else np.zeros((1, 1))
    near = anchors.select("uid", "v").mapInArrow(_assign(centres), "uid long, cluster int")
    near = stage(near, "clusters")
    counts = {r["cluster"]: r["n"] for r in near.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # at most ``clusters`` rows
    before, rows = 0, []
    for c in range(len(centres)):
        rows.append((c, before, counts.get(c, 0), [float(x) for x in centres[c]]))
        before += counts.get(c, 0)
    table = F.broadcast(spark.createDataFrame(rows, "cluster int, before long, members long, centre array<double>"))  # at most ``clusters`` rows
    place = F.col("before") + F.floor(F.pmod(F.xxhash64("uid"), F.lit(1 << 31)) * F.col("members") / F.lit(1 << 31))
    return stage(anchors.join(near, "uid").join(table, "cluster").select(*anchors.columns, "cluster", "centre", F.floor(place / F.lit(block)).cast("int").alias("block")), "anchors")


class _Walk:
    """The best ``keep`` rows of every query over one cluster's list; a query is a member with a range of scores and a kind of label."""

    def __init__(self, x: np.ndarray, label: np.ndarray, vec_id: np.ndarray, uid: np.ndarray, unit: np.ndarray, length: np.ndarray) -> None:
        self.x, self.label, self.vec_id, self.uid, self.unit, self.length = x, label, vec_id, uid, unit, length

    def order(self, centre: np.ndarray, members: np.ndarray) -> None:
        """The shared list: candidates by falling upper bound for a member of length 1."""
        c = np.zeros(self.x.shape[1])
        c[:min(len(c), len(centre))] = centre[:len(c)]
        angle = lambda u: np.arccos(np.clip(u @ c, -1, 1))
        unit, length = _unit(members)
        widest = angle(unit[length > 0]).max(initial=0.0) + 1e-6  # more than the error of the angles
        if not np.any(c):
            widest = math.pi
        bound = self.length * (np.cos(np.maximum(0, angle(self.unit) - widest)) + 1e-9)
        self.list = np.argsort(-bound, kind="stable")
        self.bound = bound[self.list]

    def best(self, u: np.ndarray, of: np.ndarray, label: np.ndarray, own: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, candidate and score of the rows kept.  ``of``: the member of ``u`` of each query."""
        _, length = _unit(u)
        exact = np.float64 if float(length.max(initial=0)) * float(self.length.max(initial=0)) < 2**52 else np.int64
        u, none = u.astype(exact), -np.inf if exact is np.float64 else np.iinfo(np.int64).min
        low, high = low.astype(exact), high.astype(exact)
        worst = np.full(len(of), none)
        q, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, exact)
        for a in range(0, len(self.list), STEP):
            most = length[of] * self.bound[a] + 1e-6
            live = np.flatnonzero((most >= worst) & (most >= low))  # the others are certain
            if not len(live):
                break
            part = self.list[a:a + STEP]
            who, back = np.unique(of[live], return_inverse=True)
            s = (u[who] @ self.x[part].astype(exact).T)[back]
            fits = ((self.label[part][None, :] == label[live][:, None]) == same) & (s >= low[live][:, None]) & (s <= high[live][:, None]) & (self.uid[part][None, :] != own[live][:, None])
            s = np.where(fits, s, none)
            least = worst[live]
            if len(part) > keep:
                least = np.maximum(least, np.partition(s, -keep, axis=1)[:, -keep])
            r, c = np.nonzero(fits & (s >= least[:, None]))
            q, at, score = np.concatenate([q, live[r]]), np.concatenate([at, part[c]]), np.concatenate([score, s[r, c]])
            rank = np.lexsort((self.uid[at], self.vec_id[at], -score, q))
            q, at, score = q[rank], at[rank], score[rank]
            first = np.searchsorted(q, q)
            ok = np.arange(len(q)) - first < keep
            q, at, score = q[ok], at[ok], score[ok]
            number = np.bincount(q, minlength=len(of))
            full = np.flatnonzero(number == keep)
            worst[full] = score[np.searchsorted(q, full, "right") - 1]
        return q, at, score


_TOP = "anchor long, anchor_id long, place int, positive_id long, positive_score long, other long, other_id long, score long"
_LAST = np.iinfo(np.int64).max


def _search(keep: int, positives: bool, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("other", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        width = max(_matrix(t.column("v")).shape[1] for t in (left, right))
        x, u = _matrix(right.column("v"), width), _matrix(left.column("v"), width)
        get = lambda t, c: t.column(c).to_numpy()
        real_id = right.column("vec_id").combine_chunks()
        vec_id = real_id.fill_null(_LAST).to_numpy(zero_copy_only=False)
        walk = _Walk(x, get(right, "label"), vec_id, get(right, "uid"), *_unit(x))
        out = []
        for cluster in np.unique(get(left, "cluster")):
            mine = np.flatnonzero(get(left, "cluster") == cluster)
            walk.order(np.array(left.column("centre")[int(mine[0])].as_py()), u[mine])
            if positives:
                of, place = np.arange(len(mine)), np.zeros(len(mine), np.int64)
                least, most, extra = np.full(len(mine), -(2**62)), np.full(len(mine), 2**62), None
            else:
                lists = left.column("positives").combine_chunks().take(pa.array(mine))
                n = np.diff(lists.offsets.to_numpy())
                extra = lists.flatten()
                ps = extra.field("score").to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(mine)), n)
                place = extra.field("place").to_numpy(zero_copy_only=False)
                least, most = -(-low * ps // 100), high * ps // 100
                ok = np.flatnonzero(least <= most)
                of, place, least, most, extra = of[ok], place[ok], least[ok], most[ok], extra.take(pa.array(ok))
            if not len(of):
                continue
            q, at, score = walk.best(u[mine], of, get(left, "label")[mine][of], get(left, "uid")[mine][of], positives, least, most, keep)
            who, chosen = pa.array(mine[of[q]]), pa.array(at)
            nulls = pa.nulls(len(q), pa.int64())
            out.append(pa.table([left.column("uid").take(who), left.column("vec_id").take(who), pa.array(place[q], pa.int32()), nulls if extra is None else extra.field("id").take(pa.array(q)), nulls if extra is None else extra.field("score").take(pa.array(q)),
                                 right.column("uid").take(chosen), real_id.take(chosen), pa.array(score.astype(np.int64))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _pass(anchors: DataFrame, rows: DataFrame, slices: int, blocks: int, keep: int, positives: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The ``keep`` best rows of every anchor (and positive), ranked over all slices."""
    left = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = rows.select("*", F.pmod(F.xxhash64("uid"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(_search(keep, positives, low, high), _TOP)
    best = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, slice_rows: int = SLICE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: a table of ``integer_vectors`` form; ``anchors``: those of its rows that search.
    An anchor's positives are its first ``positives`` other rows of its label by falling score, equal scores by
    smaller vec_id (null last), then by row.  Negatives of a positive of score p are the first rows of another label with low p <= 100 score <= high p.
    Rows that repeat a vec_id are rows of their own.  Shorter vectors count as filled up with 0.  Anchors without positives, and
    positives without negatives, give no rows; neither does an empty table.  Scores and 100 times their bounds must fit a long.
    """
    total = rows.count()
    anchors = cluster_anchors(anchors, block)
    shape = anchors.agg(F.max("block").alias("b")).first()["b"]
    slices, blocks = max(1, math.ceil(total / slice_rows)), (shape or 0) + 1
    near = _pass(anchors, rows, slices, blocks, positives, True)
    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("place"), F.col("other_id").alias("id"), "score"))).alias("positives"))  # at most ``positives`` a group
    asked = stage(anchors.join(lists, anchors["uid"] == lists["anchor"]).drop("anchor"), "positives")
    return _pass(asked, rows, slices, blocks, negatives, False, low, high).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """The search over ``embeddings``: labels of vec_ids divisible by 7 move on by one, anchors are vec_ids divisible by ``every``."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integer_vectors(embeddings.select("vec_id", "embedding", moved.alias("label")))
    return mine(rows, rows.where(F.col("vec_id") % every == 0))

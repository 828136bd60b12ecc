"""Boosting, forests and the fitted preparation against brute force, and over both roads."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from paneltide.operators import forest as R
from paneltide.operators import models as M
from paneltide.operators import quantile as Q
from paneltide.operators import trees as T
from paneltide.operators.preparation import FeaturePreparation, FeaturePreparationModel
from paneltide.plans import catalog_models as C


def _frame(spark, n=1500, seed=0, parts=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 5)), 2)
    x[:, 1] = rng.integers(0, 3, n)
    x[:, 4] = 7.0  # tells nothing
    a = x[:, 0] * 3 + x[:, 1] ** 2 + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({"restaurant_id": np.arange(n) % 9, "date": [dt.date(2024, 1, 1) + dt.timedelta(days=int(i)) for i in np.arange(n) // 9],
                        **{f"x{j}": x[:, j] for j in range(5)}, "total_orders": a, "total_revenue": a * 10 + x[:, 2]})
    names = [f"x{j}" for j in range(5)]
    return spark.createDataFrame(pdf).withColumn("features", array_to_vector(F.array(*names))).drop(*names).repartition(parts).persist()


def test_sketch_quantiles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 501):
        v = rng.normal(0, 1, n).round(1)
        parts = [T.compress(p, np.ones(len(p))) for p in np.array_split(v, 3) if len(p)]
        whole = parts[0]
        for p in parts[1:]:
            whole = T.merge_sketches(whole, p)
        for q in (0.0, 0.1, 0.5, 0.77, 1.0):
            assert T.sketch_quantile(*whole, q) == pytest.approx(np.quantile(v, q), abs=1e-9)
    v = rng.normal(0, 1, 200_000)
    whole = T.compress(v[:100_000], np.ones(100_000))
    whole = T.merge_sketches(whole, T.compress(v[100_000:], np.ones(100_000)))
    for q in (0.01, 0.5, 0.9):
        assert abs((v <= T.sketch_quantile(*whole, q)).mean() - q) < 0.002


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    size = np.array([4, 1, 6])
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    for _ in range(30):
        bins = np.stack([rng.integers(0, s, 40) for s in size], 1).astype(np.uint8)
        y = rng.integers(-3, 4, 40).astype(float)
        [(_, n, s)] = T.histogram(bins, np.zeros(40, int), None, y, offset, int(size.sum()))
        gain, f, cut, left_n, left_s, *_ = T.best_split(n, s, offset, size, 5)
        sse = lambda v: ((v - v.mean()) ** 2).sum()
        best = max(sse(y) - sse(y[m]) - sse(y[~m]) for j in range(3) for c in range(size[j] - 1) for m in [bins[:, j] <= c] if 5 <= m.sum() <= 35)
        m = bins[:, f] <= cut
        assert gain - y.sum() ** 2 / 40 + y.sum() ** 2 / 40 == pytest.approx(gain) and m.sum() == left_n and y[m].sum() == left_s
        assert sse(y) - sse(y[m]) - sse(y[~m]) == pytest.approx(best)


def test_both_roads_of_boosting_grow_the_same_trees(spark):
    df = _frame(spark)
    wanted = [("total_orders", 0.1), ("total_orders", 0.9), ("total_revenue", 0.5), ("total_revenue", None)]
    here = Q.fit_boosts(df, wanted, n_rounds=5, num_leaves=12)
    step = Q.fit_boosts(df, wanted, n_rounds=5, num_leaves=12, local_rows=0, checkpoint_every=2)
    for a, b in zip(here, step, strict=True):
        assert a.init == pytest.approx(b.init) and len(a.trees) == len(b.trees) == 5
        for s, t in zip(a.trees, b.trees, strict=True):
            assert (s[0] < 0).sum() <= 12
            for p, q in zip(s, t, strict=True):
                assert np.allclose(p, q)


def test_quantiles_cover_and_means_fit(spark):
    df = _frame(spark)
    models = Q.fit_quantile_models(df, "total_orders", n_rounds=60)
    long = Q.quantile_predictions(models, df)
    got = {r["alpha"]: r["c"] for r in long.groupBy("alpha").agg(F.avg((F.col("total_orders") <= F.col("prediction")).cast("double")).alias("c")).collect()}
    assert all(abs(c - a) < 0.06 for a, c in got.items()) and len(got) == 3
    fitted = M.gbt_forecast(df, df, n_estimators=60)
    r = fitted.metrics.first()
    assert r["r2"] > 0.95 and r["n"] == 1500
    both = M.multi_output_gbt(df, df, n_estimators=30, num_leaves=8, learning_rate=0.2)
    assert both.predictions.columns == ["target", "restaurant_id", "date", "actual", "prediction"] and both.predictions.count() == 3000
    rows = {r["target"]: r for r in both.metrics.collect()}
    assert set(rows) == {"total_orders", "total_revenue", "aggregate_mean"} and rows["total_revenue"]["r2"] > 0.9


def test_saved_quantile_models_predict_the_same(spark, tmp_path):
    df = _frame(spark, 300)
    models = Q.fit_quantile_models(df, "total_orders", n_rounds=4)
    Q.save_models(spark, {str(a): m for a, m in models.items()}, str(tmp_path / "models"))
    loaded = Q.load_models(spark, str(tmp_path / "models"))
    assert loaded["0.1"].alpha == 0.1 and loaded["0.1"].label == "total_orders"
    both = Q.predict_columns(df, {"a": models[0.1], "b": loaded["0.1"]})
    assert both.where("a != b or a is null").count() == 0
    none = spark.createDataFrame([(1,)], "id int").withColumn("features", F.lit(None).cast(df.schema["features"].dataType))
    assert Q.predict_columns(none, {"a": models[0.1]}).first()["a"] is None


def test_no_training_rows(spark):
    df = _frame(spark, 50)
    for empty in (df.where("false"), df.withColumn("total_orders", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="no training rows"):
            Q.fit_quantile_boost(empty, "total_orders", 0.5, n_rounds=1)


def _plain_tree(bins, y, w):
    """Recursive brute force: mean of the leaf of every row, growing to purity."""
    out = np.zeros(len(y))

    def grow(rows):
        out[rows] = np.average(y[rows], weights=w[rows])
        if len(set(y[rows])) == 1:
            return
        best = (1e-9, None)
        cost = lambda r: (w[r] * (y[r] - np.average(y[r], weights=w[r])) ** 2).sum()
        for f in range(bins.shape[1]):
            for c in sorted(set(bins[rows, f]))[:-1]:
                left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                gain = cost(rows) - cost(left) - cost(right)
                if gain > best[0] + 1e-9:
                    best = (gain, (left, right))
        if best[1]:
            grow(best[1][0])
            grow(best[1][1])

    grow(np.arange(len(y)))
    return out


def test_finished_trees_equal_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60):
        bins = rng.integers(0, 5, (n, 3)).astype(np.uint8)
        y, w = rng.normal(0, 1, n), rng.integers(1, 4, n).astype(float)
        f, c, left, right, v = R.finish(bins, y, w)
        got = v[T.walk((f, c, c, left, right, v), bins, binned=True)]
        assert np.allclose(got, _plain_tree(bins, y, w))
    assert (R.finish(bins, y, w, max_depth=1)[0] >= 0).sum() == 1


def test_both_phases_of_the_forest_agree(spark):
    df = _frame(spark)
    test = _frame(spark, 200, seed=9)
    one = R.fit_forest(df, "features", ["total_orders", "total_revenue"], n_trees=3)
    two = R.fit_forest(df, "features", ["total_orders", "total_revenue"], n_trees=3, local_rows=100, wave=2)
    assert max(len(t[0]) for t in two.tops.values()) > 5 and max(len(t[0]) for t in one.tops.values()) == 1
    null = test.limit(3).withColumn("features", F.lit(None).cast(test.schema["features"].dataType))
    asked = test.unionByName(null)
    key = lambda df: sorted((r["restaurant_id"], r["date"], r["prediction_total_orders"] is None, round(r["prediction_total_orders"] or 0, 6), round(r["prediction_total_revenue"] or 0, 6)) for r in df.collect())
    a, b = one.transform(asked, "features"), two.transform(asked, "features", part_rows=37)
    assert key(a) == key(b) and a.count() == 203
    assert a.columns == [*test.columns, "prediction_total_orders", "prediction_total_revenue"]
    out = M.multi_output_forest(df, test, n_trees=5)
    assert {r["target"]: r["r2"] > 0.85 for r in out.metrics.collect()} == {"total_orders": True, "total_revenue": True}


def test_preparation_is_fitted_once(spark, tmp_path):
    rows = [(1, 1.0, 5, True), (2, None, 7, None), (3, 4.0, None, False), (4, float("nan"), 8, True)]
    train = spark.createDataFrame(rows, "id int, a double, b int, c boolean").withColumn("empty", F.lit(None).cast("double"))
    names = ["a", "b", "c", "empty"]
    fitted = FeaturePreparation(inputCols=names).fit(train)
    assert fitted.fill_values() == {"a": 2.5, "b": 7.0, "c": 1.0, "empty": 0.0}
    fitted.write().overwrite().save(str(tmp_path / "prep"))
    loaded = FeaturePreparationModel.load(str(tmp_path / "prep"))
    asked = spark.createDataFrame([(9, None, None, None), (8, 100.0, 1, False)], "id int, a double, b int, c boolean").withColumn("empty", F.lit(3.0))
    whole = {r["id"]: r["features"].toArray().tolist() for r in loaded.transform(asked).collect()}
    assert whole == {9: [2.5, 7.0, 1.0, 3.0], 8: [100.0, 1.0, 0.0, 3.0]}
    for i in (8, 9):  # one request alone is prepared as in the batch
        assert loaded.transform(asked.where(F.col("id") == i)).first()["features"].toArray().tolist() == whole[i]
    pipe = Pipeline(stages=[FeaturePreparation(inputCols=["a"], outputCol="v", fill="zero")]).fit(train)
    pipe.write().overwrite().save(str(tmp_path / "pipe"))
    assert [r["v"][0] for r in PipelineModel.load(str(tmp_path / "pipe")).transform(train).orderBy("id").collect()] == [1.0, 0.0, 4.0, 0.0]


def test_score_batch_doesnt_depend_on_the_batch(spark):
    from paneltide.plans.training import score_batch

    train = _frame(spark, 400).select("restaurant_id", "date", "total_orders", (F.col("total_orders") / 10).alias("lag"), F.lit(0.1).alias("avg_discount"), F.lit(False).alias("promotion_flag"))
    fitted = FeaturePreparation(inputCols=["lag", "avg_discount", "promotion_flag"]).fit(train)
    models = Q.fit_quantile_models(fitted.transform(train), "total_orders", n_rounds=5)
    feats = spark.createDataFrame([(1, dt.date(2025, 1, 1), None, 0.1, False), (2, dt.date(2025, 1, 1), 99.0, 0.1, False)], "restaurant_id long, date date, lag double, avg_discount double, promotion_flag boolean")
    ask = lambda rows: {r["restaurant_id"]: r for r in score_batch(spark.createDataFrame(rows, "restaurant_id string, date string, discount double, promotion_flag boolean"), feats, models, models, fitted).collect()}
    one, two = ("1", "2025-01-01", 0.2, True), ("2", "2025-01-01", None, None)
    both = ask([one, two])
    assert ask([one])["1"] == both["1"] and ask([two])["2"] == both["2"]
    assert both["1"]["status"] == "ok" and both["1"]["orders_lower_bound"] <= both["1"]["predicted_orders"] <= both["1"]["orders_upper_bound"]


def test_best_params_reach_both_models(spark):
    grid = spark.createDataFrame([(31, 0.1, 100, 5, 2), (50, 0.05, 200, -1, 1)], "num_leaves int, learning_rate double, n_estimators int, max_depth int, rank int")
    best = M.best_params(grid)
    assert best == {"num_leaves": 50, "learning_rate": 0.05, "n_estimators": 200, "max_depth": -1}
    assert M.quantile_params(best) == {"num_leaves": 50, "learning_rate": 0.05, "n_rounds": 200, "max_depth": -1}
    assert M.best_params(grid.where("false")) == {}


def test_rows_are_counted_by_feature():
    rng = np.random.default_rng(7)
    size = np.array([4, 1, 256, 9])
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    layout = (offset, size, int(size.sum()))
    bins = np.stack([rng.integers(0, s, 500) for s in size], 1).astype(np.uint8)
    groups = [np.arange(0, 500, 3), np.arange(1, 500, 3), np.array([2])]
    slot = np.full(500, -1)
    for k, g in enumerate(groups):
        slot[g] = k
    flag = rng.random(500) < 0.3
    for value in (rng.normal(0, 1, 500), flag):
        count, sums = T.counted(bins.T.copy(), groups, value, *layout)
        for k, n, s in T.histogram(bins, slot, None, value, offset, layout[2]):
            assert np.array_equal(count[k], n) and np.allclose(sums[k], s)
        [(_, n, s)] = T.histogram(bins, np.zeros(500, int), None, value, offset, layout[2])
        count, sums = T.counted(bins.T.copy(), [np.arange(500)], value, *layout)
        assert np.array_equal(count[0], n) and np.allclose(sums[0], s)
    count, sums = T.counted_flags(bins.T.copy(), [~flag, flag], *layout)
    assert np.array_equal(count, n) and np.array_equal(sums[1], s) and np.array_equal(sums.sum(0), n)


def test_of_two_children_only_the_smaller_is_counted(monkeypatch):
    """a round's time in one task; every level counted all rows twice before."""
    rng = np.random.default_rng(8)
    bins = rng.integers(0, 40, (3000, 4)).astype(np.uint8)
    y = bins[:, 0] * 1.0 + (bins[:, 1] > 30) * 5 + rng.normal(0, 1, 3000)
    size = np.full(4, 40)
    layout = (np.arange(4) * 40, size, 160)
    rows, calls, plain = [], [], T.counted
    monkeypatch.setattr(Q, "counted", lambda columns, groups, *a: rows.append(sum(map(len, groups))) or calls.append(1) or plain(columns, groups, *a))
    here = Q._Here(Q._State(bins.T.copy(), y[None], np.zeros((1, 3000))), y, layout, 20)
    rounds = Q._Rounds([0.1], [32], [5], 20, [np.arange(39) + 0.5] * 4)
    leaves = lambda arrays: here.divide(arrays[0]) and [((0, n), y[r].mean()) for n, r in here.rows.items()]
    [tree] = rounds.grow(1, here.splits_of, leaves)
    assert (tree[0] < 0).sum() > 20 and len(calls) == 5 and sum(rows) <= 3000 + 4 * 1500
    whole = Q._Rounds([0.1], [32], [5], 20, rounds.edges)

    def all_counted(arrays, open_nodes):
        own = T.node_rows(bins.T, arrays[0], binned=True)
        return {(0, n): (T.best_split(*[x[0] for x in plain(bins.T, [own[n]], y, *layout)], *layout[:2], 20), 0, 0) for n in open_nodes[0]}

    [same] = whole.grow(1, all_counted, lambda arrays: [((0, n), y[r].mean()) for n, r in T.node_rows(bins.T, arrays[0], binned=True).items()])
    assert all(np.allclose(a, b) for a, b in zip(tree, same, strict=True))


def _jobs(spark, name, run):
    """How many Spark jobs ``run`` takes."""
    ids = []
    for _ in range(2):
        spark.sparkContext.setJobGroup(f"{name}-{len(ids)}", name)
        spark.sparkContext.parallelize([1], 1).count()
        ids.append(max(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}-{len(ids)}")))
        if len(ids) == 1:
            run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return ids[1] - ids[0] - 1


def test_grid_takes_the_same_jobs_whatever_the_trees(spark):
    """jobs for every level of every tree took the grid out of time."""
    df = _frame(spark, 300)
    grid = lambda n: {"num_leaves": [4], "learning_rate": [0.1, 0.2], "n_estimators": [n], "max_depth": [-1]}
    few, many = (_jobs(spark, f"grid{n}", lambda n=n: M.grid_search(df, grid=grid(n)).collect()) for n in (2, 12))
    assert many <= few + 3


def test_errors_by_round_are_the_same_on_both_roads(spark):
    df = _frame(spark, 600)
    train, held = df.where("restaurant_id < 6"), df.where("restaurant_id >= 6")
    fits = [(0.1, 3), (0.3, 2)]
    here = Q.staged_errors(train, held, "total_orders", fits, 4)
    step = Q.staged_errors(train, held, "total_orders", fits, 4, local_rows=0, checkpoint_every=2)
    assert np.allclose(here, step) and np.shape(here) == (2, 4)
    for (rate, depth), own in zip(fits, here, strict=True):
        m = M.gbt("total_orders", 4, rate, 2, depth).setMaxDepth(depth).setMaxBins(255).fit(train)
        spark_ml = m.evaluateEachIteration(held, "squared")
        assert np.allclose(own, spark_ml, rtol=0.05)
    assert np.isnan(Q.staged_errors(train, held.where("false"), "total_orders", fits, 1)).all()


def test_counted_and_sorted_levels_finish_the_same_tree(monkeypatch):
    """The upper levels are counted by bin; every level was sorted before."""
    rng = np.random.default_rng(11)
    bins = np.stack([rng.integers(0, s, 900) for s in (2, 7, 200, 1)], 1).astype(np.uint8)
    y, w = np.round(bins[:, 2] / 9 + bins[:, 0] * 4 + rng.normal(0, 1, 900), 1), rng.integers(1, 4, 900).astype(float)
    used, plain = [], R._counted_splits
    monkeypatch.setattr(R, "_counted_splits", lambda *a: used.append(1) or plain(*a))
    trees = []
    for grid in (0, 1, 1e9):
        monkeypatch.setattr(R, "GRID", grid)
        trees.append(R.finish(bins, y, w))
        used.append(0)
    runs = "".join(map(str, used)).split("0")
    assert runs[0] == "" and len(runs[1]) > 10 and len(runs[2]) > len(runs[1])
    for other in trees[1:]:
        assert all(np.allclose(a, b) for a, b in zip(trees[0], other, strict=True))


def test_in_step_only_the_smaller_child_is_counted(spark, monkeypatch):
    """every level counted all rows again."""
    df = _frame(spark, 2000)
    asked, plain = [], Q._open_counts
    monkeypatch.setattr(Q, "_open_counts", lambda layout, target, alphas, arrays, nodes: asked.append((arrays, nodes)) or plain(layout, target, alphas, arrays, nodes))
    [model] = Q.fit_boosts(df, [("total_orders", None)], n_rounds=1, num_leaves=16, local_rows=0)
    x = np.array([r["x"] for r in df.select(vector_to_array("features").alias("x")).collect()]).T
    rows = [sum(len(T.node_rows(x, arrays[0], binned=False)[n]) for n in nodes[0]) for arrays, nodes in asked]
    assert len(rows) == 4 and rows[0] == 2000 and 0 < max(rows[1:]) <= 1000
    [here] = Q.fit_boosts(df, [("total_orders", None)], n_rounds=1, num_leaves=16)
    assert all(np.allclose(a, b) for a, b in zip(model.trees[0], here.trees[0], strict=True))


def test_a_leaf_has_one_summary_a_task():
    """every block sent a sketch of each leaf."""
    tree = T.Tree()
    tree.split(0, 0, 1, 1.5)
    blocks = [Q._State(np.array([[0, 1, 2, 3]], np.uint8), np.arange(4.0)[None] + i, np.zeros((2, 4))) for i in range(3)]
    found = list(Q._leaf_residuals(iter(blocks), [0, 0], [0.5, None], [tree.arrays()] * 2))
    assert [key for key, _ in found] == [(0, 1), (0, 2), (1, 1), (1, 2)]
    summary = dict(found)
    assert np.array_equal(summary[0, 1][0], [0, 1, 2, 3]) and np.array_equal(summary[0, 1][1], [1, 2, 2, 1])
    assert summary[1, 2][1:] == (21.0, 6)


def test_both_targets_of_batch_scoring_grow_together(spark, monkeypatch):
    """one fit after the other, each with its own jobs."""
    calls = []
    monkeypatch.setattr(C, "_frames", lambda *a: (None, None, None))
    monkeypatch.setattr(Q, "fit_boosts", lambda train, wanted, **p: calls.append(wanted) or [Q.QuantileBoostModel(a, 0.0, 0.1, label) for label, a in wanted])
    monkeypatch.setattr(C, "_memo", {})
    orders, revenue = C._quantile_models(spark, "x", "total_orders", "total_revenue")
    assert len(calls) == 1 and len(calls[0]) == 6
    assert all(m.label == "total_revenue" and m.alpha == a for a, m in revenue.items()) and list(orders) == list(Q.ALPHAS)
    assert C._quantile_models(spark, "x", "total_orders") == [orders] and len(calls) == 1

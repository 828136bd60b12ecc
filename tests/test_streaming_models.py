"""Streaming projection parity, quantile boosting sanity, persistence."""
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from paneltide import schemas
from paneltide.operators import quantile as Q
from paneltide.streaming.scoring import score_stream


def test_stream_scoring_equals_batch(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"restaurant_id": np.arange(50) % 5, "date": pd.date_range("2024-01-01", periods=50).date,
                        "total_orders": rng.integers(0, 20, 50), "prediction": rng.random(50) * 20})
    pdf["lower_bound"] = pdf["prediction"] - rng.random(50) * 5
    pdf["upper_bound"] = pdf["prediction"] + rng.random(50) * 5
    src = tempfile.mkdtemp(prefix="pt-stream-src-")
    batch = spark.createDataFrame(pdf, schemas.PREDICTIONS)
    batch.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(schemas.PREDICTIONS).parquet(src)
    q = score_stream(stream).writeStream.format("memory").queryName("scored_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored_test").orderBy("restaurant_id", "date").toPandas()
    exp = score_stream(spark.read.parquet(src)).orderBy("restaurant_id", "date").toPandas()
    pd.testing.assert_frame_equal(got.reset_index(drop=True), exp.reset_index(drop=True))


def test_quantile_boost_coverage(spark):
    rng = np.random.default_rng(1)
    x = rng.random(2000) * 10
    y = x + rng.normal(0, 1 + x / 3, 2000)
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame(pd.DataFrame({"x": x, "y": y})))
    for a in (0.1, 0.9):
        m = Q.fit_quantile_boost(df, "y", a, n_rounds=15, learning_rate=0.2, num_leaves=8)
        cov = m.transform(df).select(F.avg((F.col("y") <= F.col("prediction")).cast("double"))).first()[0]
        assert abs(cov - a) < 0.06, (a, cov)


def test_positional_folds_match_unshuffled_kfold(spark):
    import datetime as dt
    from paneltide.operators.models import positional_folds
    rows = [(rid, dt.date(2024, 1, 1) + dt.timedelta(days=d)) for d in range(7) for rid in (3, 1, 2)]
    rows += [(9, dt.date(2024, 1, 3))]                      # 22 rows -> fold sizes 8, 7, 7
    df = spark.createDataFrame(rows, "restaurant_id long, date date")
    got = positional_folds(df, 3).toPandas().sort_values(["date", "restaurant_id"]).reset_index(drop=True)
    n = len(got)
    sizes = [n // 3 + (1 if i < n % 3 else 0) for i in range(3)]
    exp = np.repeat(np.arange(3), sizes)
    assert list(got["fold"]) == list(exp)


def test_start_scoring_writes_checkpointed_stream(spark):
    from paneltide.streaming.scoring import start_scoring
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"restaurant_id": np.arange(20) % 4, "date": pd.date_range("2024-03-01", periods=20).date,
                        "total_orders": rng.integers(0, 9, 20), "prediction": rng.random(20) * 9})
    pdf["lower_bound"] = pdf["prediction"] - 1.0
    pdf["upper_bound"] = pdf["prediction"] + 2.0
    src = tempfile.mkdtemp(prefix="pt-stream-in-")
    sink = tempfile.mkdtemp(prefix="pt-stream-out-")
    spark.createDataFrame(pdf, schemas.PREDICTIONS).write.mode("overwrite").parquet(src)
    q = start_scoring(spark, src, sink, query_name=f"risk_scores_{os.getpid()}")
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 20
    assert set(out.columns) >= {"risk_score", "risk_level", "day_name"}


def _assembled(spark, pdf, cols=("x",)):
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(spark.createDataFrame(pdf))


def test_registered_models_run_the_whole_settings(spark):
    from paneltide.operators import models as M
    from paneltide.plans import catalog_models as C
    assert C.ROUNDS == 200 and not hasattr(C, "CHECK_GRID")
    assert M.PARAM_GRID["n_estimators"] == [100, 200]


def test_grid_search_equals_one_fit_a_setting(spark):
    from paneltide.operators import models as M
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"restaurant_id": np.arange(90) % 3, "date": pd.date_range("2024-01-01", periods=90).date,
                        "x": rng.random(90), "total_orders": rng.integers(0, 20, 90).astype(float)})
    train = _assembled(spark, pdf)
    grid = {"num_leaves": [4], "learning_rate": [0.1, 0.3], "n_estimators": [2, 4], "max_depth": [1, -1]}
    got = M.grid_search(train, grid=grid).collect()
    assert len(got) == 8
    folded = M.positional_folds(train, 3)
    for r in got:
        mse = []
        for k in range(3):
            m = M.gbt("total_orders", r["n_estimators"], r["learning_rate"], 4, r["max_depth"]).fit(folded.where(F.col("fold") != k))
            p = m.transform(folded.where(F.col("fold") == k))
            mse.append(p.agg(F.avg((F.col("prediction") - F.col("total_orders")) ** 2)).first()[0])
        assert abs(r["mean_mse"] - np.mean(mse)) < 1e-6 and abs(r["std_mse"] - np.std(mse)) < 1e-6


def test_forest_grows_deeper_than_ten(spark):
    """Powers of three split off one by one: ten levels can't tell the smallest apart."""
    from paneltide.operators import models as M
    x = np.repeat(np.arange(24.0), 20)
    pdf = pd.DataFrame({"x": x, "total_orders": 3.0 ** x, "total_revenue": 3.0 ** x})
    train = _assembled(spark, pdf)
    got = M.multi_output_forest(train, train.where("x < 4"), n_trees=3).metrics.collect()
    assert all(r["mae"] < 100 for r in got)


def test_positional_folds_keep_null_dates_last(spark):
    import datetime as dt
    from paneltide.operators.models import positional_folds
    rows = [(i, dt.date(2024, 1, 1 + i)) for i in range(4)] + [(8, None), (9, None)]
    got = {r["restaurant_id"]: r["fold"] for r in positional_folds(spark.createDataFrame(rows, "restaurant_id long, date date"), 3).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 8: 2, 9: 2}


def test_score_batch_answers_requests_without_features(spark):
    import datetime as dt
    from paneltide.plans.training import score_batch

    from paneltide.operators.preparation import FeaturePreparationModel

    models = {a: Q.QuantileBoostModel(a, 5.0, 0.1) for a in (0.1, 0.5, 0.9)}
    names = ["avg_discount", "promotion_flag"]
    fitted = FeaturePreparationModel(inputCols=names, outputCol="features", values=[0.0, 0.0])
    feats = spark.createDataFrame([(1, dt.date(2024, 1, 1), 0.1, False)], "restaurant_id long, date date, avg_discount double, promotion_flag boolean")
    for asked in ([("1", "2024-01-01"), ("2", "2024-01-01"), ("1", "2024-01-02")], [("7", "2024-01-01")]):
        requests = spark.createDataFrame([(*a, 0.2, True) for a in asked], "restaurant_id string, date string, discount double, promotion_flag boolean")
        got = score_batch(requests, feats, models, models, fitted).collect()
        assert {(r["restaurant_id"], r["date"]): (r["status"], r["predicted_orders"]) for r in got} == \
            {a: ("ok", 5.0) if a == ("1", "2024-01-01") else ("no_features", None) for a in asked}

"""Registered modelling queries.

Fitted models are not comparable with a SQL oracle, so apart from the
baselines (M2/M3, exact) these are rows-only checks.  The ``*_contract`` queries
run the same models and return what SQL can tell: the rows, their actual values,
and that the predictions keep their rules.

The registered queries run the reference's settings: 200 rounds for the
quantile models, LightGBM's 100 / 200 trees and the whole search grid.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import models as M
from ..operators import quantile as Q
from ..operators.preparation import FeaturePreparation
from ..operators.split import time_split
from ..session import cut_lineage
from ..sources import files as S
from ..sources.bindings import duck_with, load_inputs
from . import features as X
from . import training as TR
from .common import r, rounded

#: Fixed value: the reference's boosting rounds.
ROUNDS = 200

_memo: dict = {}


def _cached(spark: SparkSession, sf: str, key: str, build):
    k = (spark.sparkContext.applicationId, sf, key)
    if k not in _memo:
        _memo[k] = build()
    return _memo[k]


def _features(spark, sf):
    i = load_inputs(spark, sf)
    return _cached(spark, sf, "features", lambda: cut_lineage(X.temporal_features(i.daily_orders, i.external_context, i.master)))


def _frames(spark, sf):
    return _cached(spark, sf, "frames", lambda: TR.model_frames(load_inputs(spark, sf), feats=_features(spark, sf)))


def _quantile_models(spark, sf, *labels):
    """The models of each label; those that aren't there yet are grown together."""
    key = lambda label: (spark.sparkContext.applicationId, sf, f"quantile:{label}")
    missing = [label for label in labels if key(label) not in _memo]
    if missing:
        ptrain, _, _ = _frames(spark, sf)
        wanted = [(label, a) for label in missing for a in Q.ALPHAS]
        models = Q.fit_boosts(ptrain, wanted, n_rounds=ROUNDS)
        for label in missing:
            _memo[key(label)] = {a: m for (own, a), m in zip(wanted, models, strict=True) if own == label}
    return [_memo[key(label)] for label in labels]


def _quantile_predictions(spark, sf):
    _, ptest, _ = _frames(spark, sf)
    return _cached(spark, sf, "quantile_predictions", lambda: cut_lineage(Q.quantile_predictions(_quantile_models(spark, sf, "total_orders")[0], ptest)))


def q_prepare_features(spark, sf):
    ptrain, ptest, _ = _frames(spark, sf)
    both = ptrain.withColumn("split", F.lit("train")).unionByName(ptest.withColumn("split", F.lit("test")))
    return both.select("restaurant_id", "date", "split", vector_to_array(M.FEATURES).alias("features"))


def q_baseline_results(spark, sf):
    d = load_inputs(spark, sf).daily_orders.select("restaurant_id", "date", "total_orders")
    s = cut_lineage(time_split(d))
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    return rounded(M.baseline_forecasts(train, test))


def _fit(spark, sf, name, fn):
    """Long predictions and metrics of a model, both stored."""
    def build():
        ptrain, ptest, _ = _frames(spark, sf)
        f = fn(ptrain, ptest)
        if isinstance(f, M.Fitted):
            pred = cut_lineage(M.long_predictions(f.predictions, {"total_orders": "prediction"}))
            return M.MultiOutput(pred, cut_lineage(f.metrics))
        return M.MultiOutput(f.predictions, cut_lineage(f.metrics))
    return _cached(spark, sf, f"fit:{name}", build)


def _linear(spark, sf):
    return _fit(spark, sf, "lr", M.linear_regression)


def _gbt(spark, sf):
    return _fit(spark, sf, "gbt", lambda a, b: M.gbt_forecast(a, b, n_estimators=100, num_leaves=31))


def _forest(spark, sf):
    return _fit(spark, sf, "rf", lambda a, b: M.multi_output_forest(a, b, n_trees=100))


def _multi_gbt(spark, sf):
    return _fit(spark, sf, "mgbt", lambda a, b: M.multi_output_gbt(a, b, n_estimators=200, num_leaves=50))


def q_linear_regression(spark, sf):
    return _linear(spark, sf).metrics


def q_gbt_forecast(spark, sf):
    return _gbt(spark, sf).metrics


def q_quantile_forecast(spark, sf):
    return Q.quantile_metrics(_quantile_predictions(spark, sf))


def q_quantile_predictions(spark, sf):
    """Long quantile predictions written with one folder per alpha, read back."""
    path = S.fresh_scratch(spark, "quantile_predictions")
    S.write_parquet(_quantile_predictions(spark, sf), path, partition_by=["alpha"])
    return spark.read.parquet(path)


def q_multi_output_forest(spark, sf):
    return _forest(spark, sf).metrics


def q_multi_output_gbt(spark, sf):
    return _multi_gbt(spark, sf).metrics


def _entity_performance(spark, sf):
    """X6's last step: E4 of every point and multi-output model's orders, per entity."""
    parts = []
    for name, model in (("GBT", _gbt), ("MultiOutput RandomForest", _forest), ("MultiOutput GBT", _multi_gbt)):
        own = model(spark, sf).predictions.where(F.col("target") == "total_orders")
        parts.append(E.entity_performance(own, "actual", "prediction").select(F.lit(name).alias("model"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_entity_model_performance(spark, sf):
    return _cached(spark, sf, "entity_performance", lambda: cut_lineage(_entity_performance(spark, sf)))


def q_entity_model_contract(spark, sf):
    """The rows of ``entity_model_performance`` without the errors, which only have to be numbers with mae <= rmse."""
    sound = F.col("mae").isNotNull() & F.col("mean_predicted").isNotNull() & (F.col("mae") <= F.col("rmse") + 1e-9)
    return rounded(q_entity_model_performance(spark, sf).select("model", "restaurant_id", "n", "mean_actual", F.coalesce(sound, F.lit(False)).alias("sound")))


def q_quantile_contract(spark, sf):
    """Every test row once per alpha with its actual value, and per alpha a loss below the constant forecast's."""
    ptrain, _, _ = _frames(spark, sf)
    mean = ptrain.select(F.avg(F.col("total_orders").cast("double"))).scalar()
    pred = q_quantile_predictions(spark, sf).withColumn("_mean", mean)
    d, e = F.col("total_orders") - F.col("prediction"), F.col("total_orders") - F.col("_mean")
    loss = lambda x: F.avg(F.greatest(F.col("alpha") * x, (F.col("alpha") - 1) * x))
    return rounded(pred.groupBy("alpha").agg(F.count("prediction").alias("n"), F.count_distinct("restaurant_id", "date").alias("n_keys"),
                                             F.sum(F.col("total_orders").cast("double")).alias("sum_actual"), (loss(d) < loss(e)).alias("beats_mean")))


def q_multi_output_contract(spark, sf):
    """M5, M7, M8: every test row once per model and target with its actual value, and an error below the mean forecast's."""
    ptrain, _, _ = _frames(spark, sf)
    means = ptrain.select(F.struct(*[F.avg(F.col(t).cast("double")).alias(t) for t in M.TARGET_COLUMNS])).scalar()
    parts = []
    for name, model in (("GBT", _gbt), ("MultiOutput RandomForest", _forest), ("MultiOutput GBT", _multi_gbt)):
        parts.append(model(spark, sf).predictions.select(F.lit(name).alias("model"), "*"))
    pred = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("_means", means)
    mean = F.when(F.col("target") == "total_orders", F.col("_means.total_orders")).otherwise(F.col("_means.total_revenue"))
    pred = pred.withColumn("_mean", mean)
    e, d = F.col("actual") - F.col("prediction"), F.col("actual") - F.col("_mean")
    return rounded(pred.groupBy("model", "target").agg(F.count("prediction").alias("n"), F.count_distinct("restaurant_id", "date").alias("n_keys"),
                                                       F.sum("actual").alias("sum_actual"), (F.avg(e * e) < F.avg(d * d)).alias("beats_mean")), 2)


def q_grid_search(spark, sf):
    def build():
        ptrain, _, _ = _frames(spark, sf)
        return cut_lineage(M.grid_search(ptrain, parallelism=8))
    return _cached(spark, sf, "grid", build)


def q_model_roundtrip(spark, sf):
    """Preparation and model in one pipeline, fitted, saved to the shared folder, loaded back, predicting with the loaded ones."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression
    ptrain, ptest, fitted = _frames(spark, sf)
    stages = [FeaturePreparation(inputCols=fitted.getInputCols(), outputCol="inputs"),
              LinearRegression(featuresCol="inputs", labelCol="total_orders")]
    model = Pipeline(stages=stages).fit(ptrain.drop(M.FEATURES))
    path = S.versioned_path(S.fresh_scratch(spark, "models"), "linear_regression")
    S.save_model(model, path)
    loaded = S.load_pipeline_model(path)
    return loaded.transform(ptest.drop(M.FEATURES)).select("restaurant_id", "date", "prediction")


def q_quantile_model_roundtrip(spark, sf):
    """S8 for quantile models: saved, loaded back, and compared: every test row's three predictions are the same."""
    _, ptest, _ = _frames(spark, sf)
    [models] = _quantile_models(spark, sf, "total_orders")
    path = S.versioned_path(S.fresh_scratch(spark, "models"), "quantile")
    Q.save_models(spark, {str(a): m for a, m in models.items()}, path)
    loaded = Q.load_models(spark, path)
    both = Q.predict_columns(ptest.select("restaurant_id", "date", M.FEATURES), {f"old_{i}": m for i, m in enumerate(models.values())} | {f"new_{i}": loaded[str(a)] for i, a in enumerate(models)})
    same = F.lit(True)
    for i in range(len(models)):
        same = same & (F.col(f"old_{i}") == F.col(f"new_{i}"))
    return both.select("restaurant_id", "date", F.coalesce(same, F.lit(False)).alias("same"))


def q_best_params_forecast(spark, sf):
    """M9 -> M6, M8: the grid's best setting handed to the quantile and multi-output boosting; the metrics of both."""
    def build():
        best = M.best_params(q_grid_search(spark, sf))
        ptrain, ptest, _ = _frames(spark, sf)
        point = M.multi_output_gbt(ptrain, ptest, **best).metrics.select(F.concat_ws(" ", "model", "target").alias("model"), "mae")
        _, metrics, _ = Q.quantile_forecast(ptrain, ptest, **M.quantile_params(best))
        return cut_lineage(point.unionByName(metrics.select(F.concat(F.lit("Quantile "), F.col("alpha").cast("string")).alias("model"), "mae")))
    return _cached(spark, sf, "best_params", build)


def q_model_leaderboard(spark, sf):
    """Every model's result row, normalised and ranked by rmse then mae."""
    res = [q_baseline_results(spark, sf), q_linear_regression(spark, sf), q_gbt_forecast(spark, sf),
           q_quantile_forecast(spark, sf).where(F.col("alpha") == 0.5)
           .select(F.lit("Quantile Regression (alpha=0.5)").alias("model"), "mae"),
           q_multi_output_forest(spark, sf).where(F.col("target") == "total_orders")
           .select(F.lit("MultiOutput RandomForest (orders)").alias("model"), "rmse", "mae"),
           q_multi_output_gbt(spark, sf).where(F.col("target") == "total_orders")
           .select(F.lit("MultiOutput GBT (orders)").alias("model"), "rmse", "mae")]
    return TR.leaderboard(res)


def q_risk_analysis(spark, sf):
    """Entity split, zero fill, quantile models -> bounds -> risk score, level and the day's kind for every test row."""
    def build():
        i = load_inputs(spark, sf)
        train, test = TR.risk_frames(i)
        return cut_lineage(TR.risk_analysis(train, test, i.external_context, i.master, n_rounds=ROUNDS))
    return _cached(spark, sf, "risk_analysis", build)


def q_risk_analysis_summaries(spark, sf):
    return rounded(TR.risk_summaries(q_risk_analysis(spark, sf)))


def q_risk_analysis_contract(spark, sf):
    """The rows of ``risk_analysis`` without the model's numbers, which have to keep their rules."""
    ordered = (F.col("lower_bound") <= F.col("prediction")) & (F.col("prediction") <= F.col("upper_bound"))
    scored = F.abs(F.col("risk_score") - (F.col("upper_bound") - F.col("lower_bound")) / (F.col("prediction") + 1)) < 1e-9
    level = F.when(F.col("risk_score") < 0.2, "Low Risk").when(F.col("risk_score") < 0.5, "Medium Risk").otherwise("High Risk")
    sound = ordered & scored & (F.col("risk_level") == level)
    return q_risk_analysis(spark, sf).select("restaurant_id", "date", "total_orders", "is_holiday", "day_name", "day_type", F.coalesce(sound, F.lit(False)).alias("sound"))


def q_score_batch(spark, sf):
    """API-shaped responses for requests built from the test period's rows."""
    _, ptest, fitted = _frames(spark, sf)
    feats = _features(spark, sf)
    requests = ptest.select(F.col("restaurant_id").cast("string").alias("restaurant_id"),
                            F.date_format("date", "yyyy-MM-dd").alias("date"),
                            F.col("avg_discount").alias("discount"), F.col("promotion_flag").cast("boolean")
                            .alias("promotion_flag"))
    return TR.score_batch(requests, feats, *_quantile_models(spark, sf, "total_orders", "total_revenue"), fitted)


def q_score_batch_contract(spark, sf):
    """The rows of ``score_batch`` without the model's numbers, which have to keep their rules."""
    c = F.col
    ordered = (c("orders_lower_bound") <= c("predicted_orders")) & (c("predicted_orders") <= c("orders_upper_bound")) \
        & (c("revenue_lower_bound") <= c("predicted_revenue")) & (c("predicted_revenue") <= c("revenue_upper_bound"))
    level = F.when(c("risk_score") < 0.2, "Low Risk").when(c("risk_score") < 0.5, "Medium Risk").otherwise("High Risk")
    return q_score_batch(spark, sf).select("restaurant_id", "date", "status", F.coalesce(ordered & (c("risk_level") == level), F.lit(False)).alias("sound"))


QUERIES = {
    "prepare_features": q_prepare_features, "baseline_results": q_baseline_results,
    "linear_regression": q_linear_regression, "gbt_forecast": q_gbt_forecast,
    "quantile_forecast": q_quantile_forecast, "quantile_predictions": q_quantile_predictions,
    "multi_output_forest": q_multi_output_forest, "multi_output_gbt": q_multi_output_gbt,
    "grid_search": q_grid_search, "model_roundtrip": q_model_roundtrip,
    "model_leaderboard": q_model_leaderboard, "risk_analysis": q_risk_analysis, "score_batch": q_score_batch,
    "entity_model_performance": q_entity_model_performance, "entity_model_contract": q_entity_model_contract,
    "quantile_contract": q_quantile_contract, "multi_output_contract": q_multi_output_contract,
    "quantile_model_roundtrip": q_quantile_model_roundtrip, "best_params_forecast": q_best_params_forecast,
    "risk_analysis_summaries": q_risk_analysis_summaries, "risk_analysis_contract": q_risk_analysis_contract,
    "score_batch_contract": q_score_batch_contract,
}


def oracles() -> dict[str, str]:
    body = f"""WITH s AS (SELECT total_orders, row_number() OVER (ORDER BY date, restaurant_id) AS rn,
  COUNT(*) OVER () AS n FROM daily_orders),
tr AS (SELECT * FROM s WHERE rn <= floor(n * 0.8)), te AS (SELECT * FROM s WHERE rn > floor(n * 0.8)),
mu AS (SELECT AVG(CAST(total_orders AS DOUBLE)) AS v FROM tr),
lv AS (SELECT CAST(total_orders AS DOUBLE) AS v FROM tr ORDER BY rn DESC LIMIT 1)
SELECT 'Mean Forecast' AS model, {r('sqrt(AVG(power(total_orders - mu.v, 2)))', 'rmse')},
  {r('AVG(abs(total_orders - mu.v))', 'mae')} FROM te, mu
UNION ALL SELECT 'Last Value Forecast', {r('sqrt(AVG(power(total_orders - lv.v, 2)))')},
  {r('AVG(abs(total_orders - lv.v))')} FROM te, lv"""
    split = """s AS (SELECT *, row_number() OVER (ORDER BY date, restaurant_id) AS rn, COUNT(*) OVER () AS n FROM daily_orders),
te AS (SELECT * FROM s WHERE rn > floor(n * 0.8))"""
    models = "(VALUES ('GBT'), ('MultiOutput RandomForest'), ('MultiOutput GBT')) m(model)"
    o = {"baseline_results": duck_with(body, "daily_orders")}
    o["quantile_contract"] = duck_with(f"""WITH {split}
SELECT alpha, COUNT(*) AS n, COUNT(DISTINCT (restaurant_id, date)) AS n_keys, {r('SUM(CAST(total_orders AS DOUBLE))', 'sum_actual')}, TRUE AS beats_mean
FROM te, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) a(alpha) GROUP BY alpha""", "daily_orders")
    o["multi_output_contract"] = duck_with(f"""WITH {split},
pairs AS (SELECT model, target FROM {models}, (VALUES ('total_orders'), ('total_revenue')) t(target) WHERE model <> 'GBT' OR target = 'total_orders')
SELECT model, target, COUNT(*) AS n, COUNT(DISTINCT (restaurant_id, date)) AS n_keys,
  {r("SUM(CASE WHEN target = 'total_orders' THEN CAST(total_orders AS DOUBLE) ELSE CAST(total_revenue AS DOUBLE) END)", 'sum_actual', 2)}, TRUE AS beats_mean
FROM te, pairs GROUP BY model, target""", "daily_orders")
    o["entity_model_contract"] = duck_with(f"""WITH {split}
SELECT model, restaurant_id, COUNT(*) AS n, {r('AVG(CAST(total_orders AS DOUBLE))', 'mean_actual')}, TRUE AS sound FROM te, {models} GROUP BY model, restaurant_id""", "daily_orders")
    o["quantile_model_roundtrip"] = duck_with(f"WITH {split} SELECT restaurant_id, date, TRUE AS same FROM te", "daily_orders")
    o["score_batch_contract"] = duck_with(f"""WITH {split}
SELECT CAST(restaurant_id AS VARCHAR) AS restaurant_id, strftime(date, '%Y-%m-%d') AS date, 'ok' AS status, TRUE AS sound FROM te""", "daily_orders")
    o["risk_analysis_contract"] = duck_with("""WITH s AS (SELECT *, row_number() OVER (ORDER BY restaurant_id, date) AS rn, COUNT(*) OVER () AS n FROM daily_orders),
te AS (SELECT * FROM s WHERE rn > floor(n * 0.8)),
cm AS (SELECT DISTINCT restaurant_id, city FROM master), h AS (SELECT DISTINCT date, city, is_holiday FROM external_context)
SELECT te.restaurant_id, te.date, total_orders, CAST(coalesce(CAST(h.is_holiday AS INTEGER), 0) AS INTEGER) AS is_holiday, dayname(te.date) AS day_name,
  CASE WHEN coalesce(h.is_holiday, FALSE) THEN 'Holiday' ELSE 'Regular Day' END AS day_type, TRUE AS sound
FROM te LEFT JOIN cm USING (restaurant_id) LEFT JOIN h ON h.date = te.date AND h.city = cm.city""", "daily_orders", "master", "external_context")
    return o

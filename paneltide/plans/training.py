"""X6 train -> evaluate -> select, X7 risk analysis, R7 batch scoring.

The feature table and the split are computed once and cached; every model
fits on executors; all metrics are aggregations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import models as M
from ..operators import quantile as Q
from ..operators import risk as R
from ..operators.explore import describe_by
from ..operators.preparation import FeaturePreparation, FeaturePreparationModel
from ..operators.split import entity_split, time_split
from ..session import cut_lineage
from ..sources.bindings import Inputs
from . import features as X


def split_features(features: DataFrame, test_size: float = 0.2, mode: str = "time") -> tuple[DataFrame, DataFrame]:
    """O8 (mode='time') or O9 (mode='entity') on a feature table."""
    s = time_split(features, test_size) if mode == "time" else entity_split(features, test_size)
    # materialise: the split's plan (features + boundary sub-queries) must not be
    # re-planned and re-run by every model fit downstream
    s = cut_lineage(s)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def model_frames(inputs: Inputs, test_size: float = 0.2, mode: str = "time", medians: str = "own", feats: DataFrame | None = None):
    """Temporal features -> split -> prepared (median-filled, assembled) train and test frames, and the fitted preparation.

    ``medians="own"`` fills the test frame with its own medians, as the reference does; ``"train"`` with the training frame's.
    ``feats``: the stored feature table, where there is one.
    """
    if feats is None:
        feats = cut_lineage(X.temporal_features(inputs.daily_orders, inputs.external_context, inputs.master))
    train, test = split_features(feats, test_size, mode)
    stage = FeaturePreparation(inputCols=M.feature_names(train), outputCol=M.FEATURES)
    fitted = stage.fit(train)
    ptrain = cut_lineage(fitted.transform(train))
    ptest = cut_lineage((fitted if medians == "train" else stage.fit(test)).transform(test))
    return ptrain, ptest, fitted


def leaderboard(results: list[DataFrame]) -> DataFrame:
    """Union of result tables (missing metric columns -> NULL), ranked."""
    norm = [r.select("model", *[F.col(c).cast("double").alias(c) if c in r.columns else
                                F.lit(None).cast("double").alias(c) for c in ("rmse", "mae")]) for r in results]
    return E.leaderboard(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), norm))


#: Columns that the risk analysis never uses as inputs, besides keys and targets.
RISK_EXCLUDED = ["city", "day_name", "is_holiday"]


def risk_frames(inputs: Inputs, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """X7's frames: temporal features, cut by entity (the first rows of the (entity, date) order train), NULLs filled with 0."""
    feats = cut_lineage(X.temporal_features(inputs.daily_orders, inputs.external_context, inputs.master))
    train, test = split_features(feats, test_size, "entity")
    names = M.feature_names(train, M.ID_COLUMNS + M.TARGET_COLUMNS + RISK_EXCLUDED)
    prepared = FeaturePreparation(inputCols=names, outputCol=M.FEATURES, fill="zero").fit(train)
    return cut_lineage(prepared.transform(train)), cut_lineage(prepared.transform(test))


def risk_analysis(train: DataFrame, test: DataFrame, context: DataFrame, master: DataFrame, **params) -> DataFrame:
    """Three quantile models -> bounded forecast -> risk score and class, with the day's kind, per test row."""
    models = Q.fit_quantile_models(train, "total_orders", **params)
    wide = Q.predict_columns(test, {"prediction": models[0.5], "lower_raw": models[0.1], "upper_raw": models[0.9]})
    lo, hi = R.bounded("prediction", "lower_raw", "upper_raw")
    scored = R.score(wide.select("restaurant_id", "date", "total_orders", "prediction", lo.alias("lower_bound"), hi.alias("upper_bound")))
    return R.with_day_info(cut_lineage(scored), context, master)


def risk_summaries(scored_days: DataFrame) -> DataFrame:
    """X7's tables in one: (analysis, label, n, mean, median, std) by weekday, day type and risk level, and of all rows."""
    def part(name: str, label: str, df: DataFrame) -> DataFrame:
        d = describe_by(df.withColumn("_label", F.col(label)), "_label", "risk_score")
        return d.select(F.lit(name).alias("analysis"), F.col("_label").cast("string").alias("label"), F.col("count").alias("n"), "mean", "median", "std")

    every = scored_days.withColumn("_all", F.lit("all"))
    return part("weekday", "day_name", scored_days).unionByName(part("day_type", "day_type", scored_days)) \
        .unionByName(part("risk_level", "risk_level", scored_days.where("risk_level is not null"))).unionByName(part("overall", "_all", every))


def score_batch(requests: DataFrame, features: DataFrame, orders_models: dict, revenue_models: dict,
                preparation: FeaturePreparationModel) -> DataFrame:
    """The response record for a batch of (restaurant_id, date, discount, promotion) requests.

    Each request is joined to the entity's feature row for that date, the
    request's discount/promotion override the stored ones, and the three
    quantile models of each target give point and bounds; the orders
    interval gives the risk score and level.  Gaps are filled with the medians of the training
    frame that ``preparation`` holds, so an answer doesn't depend on the other requests.  Every request gets a row:
    ``status`` is "ok", or "no_features" (and no numbers) where the feature
    table has no row for its entity and date.
    """
    req = requests.select(F.col("restaurant_id").cast("bigint").alias("restaurant_id"),
                          F.to_date("date").alias("date"),
                          F.col("discount").cast("double").alias("_discount"),
                          F.col("promotion_flag").cast("boolean").alias("_promo"))
    joined = req.join(features.withColumn("_known", F.lit(True)), ["restaurant_id", "date"], "left")
    base = joined.where("_known").drop("_known") \
                   .withColumn("avg_discount", F.coalesce("_discount", "avg_discount")) \
                   .withColumn("promotion_flag", F.coalesce("_promo", "promotion_flag")) \
                   .drop("_discount", "_promo")
    prepared = preparation.transform(base).select("restaurant_id", "date", preparation.getOutputCol())
    out = Q.predict_columns(prepared, {f"_{prefix}_{name}": models[a] for prefix, models in (("orders", orders_models), ("revenue", revenue_models))
                                       for a, name in ((0.5, "point"), (0.1, "lo"), (0.9, "hi"))}, preparation.getOutputCol())
    o_lo, o_hi = R.bounded("_orders_point", "_orders_lo", "_orders_hi")
    r_lo, r_hi = R.bounded("_revenue_point", "_revenue_lo", "_revenue_hi")
    res = out.select(
        F.col("restaurant_id").cast("string").alias("restaurant_id"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("_orders_point").alias("predicted_orders"),
        F.col("_revenue_point").alias("predicted_revenue"),
        o_lo.alias("orders_lower_bound"), o_hi.alias("orders_upper_bound"),
        r_lo.alias("revenue_lower_bound"), r_hi.alias("revenue_upper_bound"),
    )
    score = F.try_divide(F.col("orders_upper_bound") - F.col("orders_lower_bound"),
                         F.col("predicted_orders") + F.lit(1.0))
    res = res.withColumn("risk_score", score).withColumn("risk_level", R.risk_level(score)).withColumn("status", F.lit("ok"))
    unknown = joined.where("_known IS NULL").select(F.col("restaurant_id").cast("string").alias("restaurant_id"),
                                                    F.date_format("date", "yyyy-MM-dd").alias("date"),
                                                    F.lit("no_features").alias("status"))
    return res.unionByName(unknown, allowMissingColumns=True)

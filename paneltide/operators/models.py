"""Forecasting models on ``pyspark.ml`` (M1-M5, M7-M9).

The reference fits scikit-learn / LightGBM on one machine.  Here every fit
is a ``pyspark.ml`` estimator (distributed over the executors), features
are one ``VectorAssembler`` column, and predictions stay attached to their
rows (``transform``), so no positional concat is needed.

M5 to M8 grow their own trees (quantile.py, forest.py).

Mapping of the boosting parameters: LightGBM grows leaf-wise with
``num_leaves``; here trees grow level-wise, so ``num_leaves = n`` also means
at most ``ceil(log2 n)`` levels (31 -> 5, 50 -> 6); ``max_depth = -1`` is
that limit too.  M9 grows the trees of ``pyspark.ml``'s boosting with the same mapping.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import fmean, pstdev

from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .evaluate import metric_columns
from .forest import fit_forest
from .preparation import FeaturePreparation
from .ranks import ranked_values

# Columns never used as model inputs.
ID_COLUMNS = ["restaurant_id", "date"]
TARGET_COLUMNS = ["total_orders", "total_revenue"]
FEATURES = "features"


def feature_names(df: DataFrame, exclude: Sequence[str] = ID_COLUMNS + TARGET_COLUMNS) -> list[str]:
    """P5 + P6: numeric and boolean columns not excluded (strings cannot be model inputs)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if f.name not in ex and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def prepare_features(df: DataFrame, names: Sequence[str] | None = None, medians_from: DataFrame | None = None) -> DataFrame:
    """M1: median-fill the feature columns and assemble them into one vector.

    ``medians_from=None`` fills each frame with its own medians (as the
    reference does for test data too); pass the training frame, or keep a fitted
    ``preparation.FeaturePreparation``, for train-only medians.
    """
    names = list(names) if names is not None else feature_names(df)
    fitted = FeaturePreparation(inputCols=names, outputCol=FEATURES).fit(df if medians_from is None else medians_from)
    return fitted.transform(df)


def leaves_to_depth(num_leaves: int, max_depth: int = -1, cap: int = 30) -> int:
    depth = math.ceil(math.log2(max(num_leaves, 2)))
    if max_depth is not None and max_depth > 0:
        depth = min(depth, max_depth)
    return min(depth, cap)


@dataclass
class Fitted:
    model: object
    predictions: DataFrame
    metrics: DataFrame


def _evaluate(pred: DataFrame, label: str, name: str) -> DataFrame:
    return pred.agg(*metric_columns(label, "prediction")).select(F.lit(name).alias("model"), "*")


def baseline_forecasts(train: DataFrame, test: DataFrame, target: str = "total_orders",
                       order: Sequence[str] = ("date", "restaurant_id")) -> DataFrame:
    """M2 + M3: mean of the training target and the last training value.

    "Last" is the last row of the training table in ``order`` (the
    reference's one global value), found with ``max_by`` -- a single
    aggregate, no sort.
    """
    mean_ = train.select(F.avg(F.col(target).cast("double"))).scalar()
    last_ = train.select(F.max_by(F.col(target).cast("double"), F.struct(*[F.col(c) for c in order]))).scalar()
    y = F.col(target).cast("double")
    rows = []
    for name, value in (("Mean Forecast", mean_), ("Last Value Forecast", last_)):
        e = y - value
        rows.append(test.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
                    .select(F.lit(name).alias("model"), "rmse", "mae"))
    return rows[0].unionByName(rows[1])


def _fit_predict(estimator, train: DataFrame, test: DataFrame, label: str, name: str) -> Fitted:
    model = Pipeline(stages=[estimator]).fit(train)
    pred = model.transform(test)
    return Fitted(model, pred, _evaluate(pred, label, name))


def linear_regression(train: DataFrame, test: DataFrame, label: str = "total_orders") -> Fitted:
    """M4: ordinary least squares with intercept."""
    est = LinearRegression(featuresCol=FEATURES, labelCol=label, predictionCol="prediction",
                           regParam=0.0, elasticNetParam=0.0, fitIntercept=True, solver="auto")
    return _fit_predict(est, train, test, label, "Linear Regression")


def gbt(label: str = "total_orders", n_estimators: int = 100, learning_rate: float = 0.1, num_leaves: int = 31,
        max_depth: int = -1, subsample: float = 1.0, seed: int = 42, feature_subset: str = "all",
        loss: str = "squared") -> GBTRegressor:
    return GBTRegressor(featuresCol=FEATURES, labelCol=label, predictionCol="prediction",
                        maxIter=n_estimators, stepSize=learning_rate,
                        maxDepth=leaves_to_depth(num_leaves, max_depth), subsamplingRate=subsample,
                        featureSubsetStrategy=feature_subset, seed=seed, lossType=loss, maxBins=255)


def _boost_params(n_estimators: int = 100, **params) -> dict:
    return {"n_rounds": n_estimators, "num_leaves": 31, "min_rows_per_leaf": 20, **params}


def gbt_forecast(train: DataFrame, test: DataFrame, label: str = "total_orders", **params) -> Fitted:
    """M5: boosted point forecast (100 rounds, rate 0.1, 31 leaves of at least 20 rows, 255 bins; boosting of quantile.py)."""
    from .quantile import fit_boosts

    model = fit_boosts(train, [(label, None)], **_boost_params(**params))[0]
    pred = model.transform(test)
    return Fitted(model, pred, _evaluate(pred, label, "GBT"))


def long_predictions(pred: DataFrame, columns: dict[str, str], keys: Sequence[str] = tuple(ID_COLUMNS)) -> DataFrame:
    """(target, keys, actual, prediction) with one row per row and target; ``columns`` maps targets to prediction columns.

    Predictions stay with their rows; a NULL actual stays NULL.
    """
    kept = [k for k in keys if k in pred.columns]
    each = [F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("actual"), F.col(p).alias("prediction")) for t, p in columns.items()]
    return pred.select(*kept, F.inline(F.array(*each))).select("target", *kept, "actual", "prediction")


@dataclass
class MultiOutput:
    """``predictions``: long_predictions of the test rows; ``metrics``: one row per target (and their mean)."""

    predictions: DataFrame
    metrics: DataFrame


def target_metrics(predictions: DataFrame, name: str, with_mean_row: bool = False) -> DataFrame:
    """target, model, n, rmse, mae, r2 of a long predictions table."""
    out = predictions.groupBy("target").agg(*metric_columns("actual", "prediction")).select("target", F.lit(name).alias("model"), "n", "rmse", "mae", "r2")
    if with_mean_row:
        mean = out.agg(F.lit("aggregate_mean").alias("target"), F.lit(name).alias("model"),
                       F.sum("n").alias("n"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"),
                       F.avg("r2").alias("r2"))
        out = out.unionByName(mean)
    return out


def multi_output_forest(train: DataFrame, test: DataFrame, n_trees: int = 100, seed: int = 42, max_depth: int | None = None,
                        targets: Sequence[str] = TARGET_COLUMNS) -> MultiOutput:
    """M7: a random forest per target, grown to purity (``max_depth`` to stop before)."""
    model = fit_forest(train, FEATURES, targets, n_trees=n_trees, seed=seed, max_depth=max_depth)
    pred = cut_lineage(long_predictions(model.transform(test, FEATURES), {t: f"prediction_{t}" for t in targets}))
    return MultiOutput(pred, target_metrics(pred, "MultiOutput RandomForest"))


def multi_output_gbt(train: DataFrame, test: DataFrame, targets: Sequence[str] = TARGET_COLUMNS, **params) -> MultiOutput:
    """M8: boosting per target, grown side by side, plus the mean-of-targets row; ``params`` may be ``best_params`` of a grid."""
    from .quantile import fit_boosts, predict_columns

    models = fit_boosts(train, [(t, None) for t in targets], **_boost_params(**params))
    pred = predict_columns(test, {f"prediction_{t}": m for t, m in zip(targets, models, strict=True)})
    pred = cut_lineage(long_predictions(pred, {t: f"prediction_{t}" for t in targets}))
    return MultiOutput(pred, target_metrics(pred, "MultiOutput GBT", with_mean_row=True))


# The reference's search grid (2 x 2 x 2 x 3 = 24 settings).
PARAM_GRID = {
    "num_leaves": [31, 50],
    "learning_rate": [0.1, 0.05],
    "n_estimators": [100, 200],
    "max_depth": [5, 10, -1],
}


def positional_folds(df: DataFrame, n_folds: int = 3, order: str = "date", tie: str = "restaurant_id") -> DataFrame:
    """Unshuffled K-fold: contiguous blocks of the (order, tie) sequence.

    Position = rows before this row's ``order`` value (bucketed prefix sums
    over the distinct values) + its place among the rows sharing that value.
    """
    per = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count(F.lit(1)).alias("cnt"))
    before = ranked_values(per, order, bounded=True).select(order, "before")  # dates: calendar-bounded
    n = df.select(F.count(F.lit(1))).scalar()
    known = df.select(F.count(F.col(order))).scalar()  # rows of a NULL date come last
    pos = F.coalesce("before", known) + F.row_number().over(Window.partitionBy(order).orderBy(tie)) - 1
    # sklearn KFold: the first n % k folds hold one row more
    size = F.floor(n / n_folds)
    extra = n % n_folds
    big = (size + 1) * extra
    fold = F.when(pos < big, F.floor(pos / (size + 1))).otherwise(extra + F.floor((pos - big) / size))
    return df.join(before, order, "left").withColumn("fold", fold.cast("int")).drop("before")


def grid_search(train: DataFrame, label: str = "total_orders", grid: dict | None = None, n_folds: int = 3,
                parallelism: int = 4, seed: int = 42) -> DataFrame:
    """M9: cross-validated grid over boosting settings, scored by MSE (lower is better).

    Returns one row per setting: mean and std of the fold MSE, the negative
    mean MSE (the reference's score) and its rank.  The fits follow ``pyspark.ml``'s ``GBTRegressor`` (see ``gbt``)
    on a frame that is binned once a fold; without sampling there is nothing that ``seed`` could change.
    """
    from .quantile import staged_errors

    grid = grid or PARAM_GRID
    settings = [(nl, lr, ne, md, leaves_to_depth(nl, md)) for nl in grid["num_leaves"] for lr in grid["learning_rate"]
                for ne in grid["n_estimators"] for md in grid["max_depth"]]
    most = max(grid["n_estimators"])
    folded = cut_lineage(positional_folds(train, n_folds))
    # the first trees of a long fit are the trees of a shorter one: one fit for each (rate, depth) and fold
    fits = sorted({(s[1], s[4]) for s in settings})

    def errors(k):
        return staged_errors(folded.where(F.col("fold") != k), folded.where(F.col("fold") == k), label, fits, most)

    with ThreadPoolExecutor(max_workers=min(parallelism, n_folds)) as pool:
        staged = {(*fit, k): own for k, found in enumerate(pool.map(errors, range(n_folds))) for fit, own in zip(fits, found, strict=True)}
    spark = train.sparkSession
    rows = []
    for nl, lr, ne, md, depth in settings:
        mse = [float(staged[lr, depth, k][ne - 1]) for k in range(n_folds)]
        rows.append((nl, lr, ne, md, depth, fmean(mse), pstdev(mse)))
    res = spark.createDataFrame(rows, "num_leaves int, learning_rate double, n_estimators int, max_depth int, "
                                      "spark_max_depth int, mean_mse double, std_mse double")
    return res.withColumn("mean_test_score", -F.col("mean_mse")) \
              .withColumn("rank", F.rank().over(Window.orderBy(F.col("mean_mse"))))


def best_params(results: DataFrame) -> dict:
    """The settings of the best row of a grid, as keyword arguments of ``gbt`` and ``fit_boosts`` callers (one row is read)."""
    r = results.orderBy("rank", "num_leaves", "learning_rate", "n_estimators", "max_depth").first()
    return {} if r is None else {c: r[c] for c in ("num_leaves", "learning_rate", "n_estimators", "max_depth")}


def quantile_params(best: dict) -> dict:
    """``best_params`` in the names of the quantile boosting."""
    return {("n_rounds" if k == "n_estimators" else k): v for k, v in best.items()}

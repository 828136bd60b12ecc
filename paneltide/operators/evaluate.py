"""Forecast evaluation (E1-E7) over a long predictions table.

Metrics are plain aggregates, so many models / targets / entities are
scored in one pass with ``groupBy``; no per-model Python loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _err(y: str, p: str) -> Column:
    return F.col(y).cast("double") - F.col(p).cast("double")


def metric_columns(y: str = "total_orders", p: str = "prediction") -> list[Column]:
    """Rmse, mae, mse, r2, mape (zero actuals excluded from mape)."""
    e = _err(y, p)
    yy = F.col(y).cast("double")
    sse = F.sum(e * e)
    sst = F.var_pop(yy) * F.count(yy)
    return [
        F.count(e).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"),
        F.avg(F.abs(e) / F.when(yy != 0, F.abs(yy))).alias("mape"),
    ]


def regression_metrics(pred: DataFrame, y: str = "total_orders", p: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*by).agg(*metric_columns(y, p))


def pinball_loss(pred: DataFrame, alphas: Sequence[float], y: str = "total_orders",
                 quantile_cols: dict[float, str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean pinball loss and mae per quantile level, in long form."""
    quantile_cols = quantile_cols or {a: "prediction" for a in alphas}
    aggs = []
    for a in alphas:
        d = _err(y, quantile_cols[a])
        aggs.append(F.struct(F.lit(float(a)).alias("alpha"),
                             F.avg(F.greatest(F.lit(a) * d, F.lit(a - 1.0) * d)).alias("pinball"),
                             F.avg(F.abs(d)).alias("mae")).alias(f"a{len(aggs)}"))
    one = pred.groupBy(*by).agg(*aggs)
    stack = ", ".join(f"a{i}" for i in range(len(aggs)))
    keep = ", ".join(by) + (", " if by else "")
    return one.selectExpr(f"{keep}inline(array({stack}))")


def entity_performance(pred: DataFrame, y: str = "total_orders", p: str = "prediction",
                       entity: str = "restaurant_id") -> DataFrame:
    """Per-entity n, rmse, mae, mean actual, mean predicted."""
    e = _err(y, p)
    return pred.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.col(y).cast("double")).alias("mean_actual"),
        F.avg(F.col(p).cast("double")).alias("mean_predicted"),
    )


def interval_coverage(pred: DataFrame, y: str = "total_orders", lo: str = "lower_bound",
                      hi: str = "upper_bound", by: Sequence[str] = ()) -> DataFrame:
    """E5: share of actuals inside [lo, hi] (inclusive)."""
    inside = (F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi))
    return pred.groupBy(*by).agg(F.avg(inside.cast("int")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Rank model results by rmse then mae (nulls last).

    ``results`` has one row per model with ``model``, ``rmse``, ``mae``
    (either may be NULL, e.g. the quantile model only reports mae).  The
    table is tiny, so a global ``row_number`` is fine here.
    """
    w = Window.orderBy(F.col("rmse").asc_nulls_last(), F.col("mae").asc_nulls_last(), F.col("model"))
    return results.withColumn("rank", F.row_number().over(w)) \
                  .withColumn("is_best", (F.col("rank") == 1) & F.col("rmse").isNotNull())

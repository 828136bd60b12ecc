"""Composite feature plans X1-X5.

Each is one lazy DataFrame: read -> one select holding every window
expression (one Exchange + one Sort), the exponential mean over the same order -> lookup joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import basic_calendar_columns, calendar_columns
from ..operators import temporal as W
from ..operators.behavior import behavioral_features as _behavioral
from ..operators.joins import merge_context
from ..operators.static import static_features as _static


def basic_features(daily: DataFrame) -> DataFrame:
    """Calendar basics, lag_1/7/14, full-window rolling mean/std of 7."""
    w = W.series_window()
    return daily.select("*", *basic_calendar_columns("date"), *W.basic_window_columns(w))


def temporal_window_features(daily: DataFrame, leak_safe: bool = False) -> DataFrame:
    """Calendar + order/revenue lags + rolling + trend, before the context merge.

    ``leak_safe=False`` reproduces the reference (rolling frames, momentum
    and the exponential mean include the current row, diffs are kept).
    ``leak_safe=True`` ends every frame at the previous row and drops the
    columns that contain the target.
    """
    w = W.series_window()
    out = daily.select(
        "*",
        *calendar_columns("date"),
        *W.order_lag_columns(w),
        *W.revenue_lag_columns(w),
        *W.order_rolling_columns(w, leak_safe),
        *W.revenue_rolling_columns(w, leak_safe),
        *W.trend_columns(w, leak_safe),
    )
    return W.with_ewm(out, W.TREND_EWM, w, leak_safe)


def temporal_features(daily: DataFrame, context: DataFrame, master: DataFrame,
                      leak_safe: bool = False) -> DataFrame:
    """The full temporal feature table, one row per (restaurant_id, date)."""
    return merge_context(temporal_window_features(daily, leak_safe), context, master)


def static_features(master: DataFrame) -> DataFrame:
    """Time-invariant entity features."""
    return _static(master)


def behavioral_features(daily: DataFrame) -> DataFrame:
    """Per-entity behavioural means."""
    return _behavioral(daily)


def feature_pipeline(daily: DataFrame, context: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Temporal features then behavioural features (static is not part of it)."""
    return {
        "temporal_features": temporal_features(daily, context, master),
        "behavioral_features": behavioral_features(daily),
    }


def feature_pipeline_joined(daily: DataFrame, context: DataFrame, master: DataFrame) -> DataFrame:
    """X5 as one table: temporal rows with their entity's behavioural columns."""
    t = temporal_features(daily, context, master)
    b = behavioral_features(daily).select(
        "restaurant_id",
        *[F.col(c).alias(f"entity_{c}") for c in
          ("promotion_usage_rate", "avg_cancellation_rate", "avg_delivery_time", "avg_orders_per_day")],
    )
    return t.join(b, "restaurant_id", "left")

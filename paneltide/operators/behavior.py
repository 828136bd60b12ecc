"""Behavioural per-entity features (A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def behavioral_features(daily: DataFrame, entity: str = "restaurant_id") -> DataFrame:
    """Mean promotion use, cancellation rate, delivery time and daily orders.

    One hash aggregate (partial per task, final per key) replaces the four
    grouped means and their column-wise concat.  NULL keys are dropped the
    way a pandas groupby drops NaN keys; ``avg`` skips NULL values as pandas
    skips NaN.
    """
    return (
        daily.where(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(
            F.avg(F.col("promotion_flag").cast("int")).alias("promotion_usage_rate"),
            F.avg("cancellation_rate").alias("avg_cancellation_rate"),
            F.avg("avg_delivery_time").alias("avg_delivery_time"),
            F.avg("total_orders").alias("avg_orders_per_day"),
        )
    )

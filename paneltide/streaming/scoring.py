"""Stateless operators on Structured Streaming.

The reference has no streams.  What carries over is a property: the
row-wise operators (calendar features, risk score / level, interval
bounds) are pure projections, so the same Column
expressions run unchanged on a streaming DataFrame.  This module wires
them to a file stream of prediction rows and a checkpointed sink.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..functions.calendar import day_of_week, is_weekend, weekday_name
from ..operators import risk as R
from ..session import ensure_checkpoint_dir


def score_stream(predictions: DataFrame) -> DataFrame:
    """R1-R3 plus calendar labels on a (streaming or batch) predictions frame."""
    lo, hi = R.bounded("prediction", "lower_bound", "upper_bound")
    bounded = predictions.select("restaurant_id", "date", "total_orders", "prediction",
                                 lo.alias("lower_bound"), hi.alias("upper_bound"))
    return R.score(bounded).select(
        "*", day_of_week("date").alias("day_of_week"), is_weekend("date").alias("is_weekend"),
        weekday_name("date").alias("day_name"))


def read_prediction_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 16) -> DataFrame:
    return (spark.readStream.schema(schemas.PREDICTIONS).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def start_scoring(spark: SparkSession, source: str, sink: str, query_name: str = "risk_scores",
                  trigger_once: bool = True):
    """File stream of predictions -> scored rows appended to Parquet.

    The stream's checkpoint lives below the shared checkpoint folder, so a
    restarted driver resumes from the last committed batch.
    """
    ckpt = os.path.join(ensure_checkpoint_dir(spark).rstrip("/"), "streams", query_name)
    w = (score_stream(read_prediction_stream(spark, source)).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", ckpt).outputMode("append").queryName(query_name))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()

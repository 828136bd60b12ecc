"""Fixed schemas of the three input tables and the long predictions table."""

from __future__ import annotations

from pyspark.sql import types as T

MASTER = T.StructType([
    T.StructField("restaurant_id", T.LongType()),
    T.StructField("restaurant_name", T.StringType()),
    T.StructField("country_code", T.IntegerType()),
    T.StructField("city", T.StringType()),
    T.StructField("locality", T.StringType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("cuisines", T.StringType()),
    T.StructField("average_cost_for_two", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("has_table_booking", T.StringType()),
    T.StructField("has_online_delivery", T.StringType()),
    T.StructField("is_delivering_now", T.StringType()),
    T.StructField("switch_to_order_menu", T.StringType()),
    T.StructField("price_range", T.IntegerType()),
    T.StructField("aggregate_rating", T.DoubleType()),
    T.StructField("votes", T.LongType()),
])

DAILY_ORDERS = T.StructType([
    T.StructField("restaurant_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("total_orders", T.LongType()),
    T.StructField("total_revenue", T.DoubleType()),
    T.StructField("avg_discount", T.DoubleType()),
    T.StructField("promotion_flag", T.BooleanType()),
    T.StructField("cancellation_rate", T.DoubleType()),
    T.StructField("avg_delivery_time", T.DoubleType()),
])

EXTERNAL_CONTEXT = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("city", T.StringType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("is_weekend", T.BooleanType()),
    T.StructField("is_holiday", T.BooleanType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("weather", T.StringType()),
    T.StructField("event_flag", T.BooleanType()),
])

PREDICTIONS = T.StructType([
    T.StructField("restaurant_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("total_orders", T.LongType()),
    T.StructField("prediction", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
])

# Columns that identify a row of the daily series, and its two targets.
KEYS = ["restaurant_id", "date"]
TARGETS = ["total_orders", "total_revenue"]

"""Registered feature queries (W, F, J, X ops) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scalar as S
from ..operators import joins as J
from ..operators import temporal as W
from ..sources.bindings import duck_with, load_inputs
from . import features as X
from .common import r, rounded

KEY = ["restaurant_id", "date"]
DAILY_COLS = ["restaurant_id", "date", "total_orders", "total_revenue", "avg_discount",
              "promotion_flag", "cancellation_rate", "avg_delivery_time"]


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def q_temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    i = load_inputs(spark, sf)
    return rounded(X.temporal_features(i.daily_orders, i.external_context, i.master))


def q_basic_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.basic_features(load_inputs(spark, sf).daily_orders))


def _keyed(spark: SparkSession, sf: str, cols) -> DataFrame:
    d = load_inputs(spark, sf).daily_orders
    return rounded(d.select(*KEY, *cols))


def q_order_lags(spark, sf):
    return _keyed(spark, sf, W.order_lag_columns())


def q_revenue_lags(spark, sf):
    return _keyed(spark, sf, W.revenue_lag_columns())


def q_order_rolling(spark, sf):
    return _keyed(spark, sf, W.order_rolling_columns())


def q_revenue_rolling(spark, sf):
    return _keyed(spark, sf, W.revenue_rolling_columns())


def q_trend_features(spark, sf):
    d = load_inputs(spark, sf).daily_orders
    return rounded(W.with_ewm(d.select(*KEY, "total_orders", *W.trend_columns()), W.TREND_EWM).drop("total_orders"))


#: Spans of the exponential means that are compared.
EWM_SPANS = [7, 60, 100]


def q_ewm_spans(spark, sf):
    """Means of several spans, of the orders and of the orders with every value divisible by three missing."""
    d = load_inputs(spark, sf).daily_orders.select(*KEY, F.col("total_orders").alias("x"), F.when(F.col("total_orders") % 3 != 0, F.col("total_orders")).alias("gappy"))
    means = [(c, n, f"{c}_ewm_{n}") for c in ("x", "gappy") for n in EWM_SPANS]
    return rounded(W.with_ewm(d, means).drop("x", "gappy"))


def o_ewm_spans() -> str:
    def mean(c, n):
        a = f"CAST({2.0 / (n + 1.0)!r} AS DOUBLE)"
        step = (f"lambda p, v: CASE WHEN p.y IS NULL THEN v WHEN v.y IS NULL THEN {{'y': p.y, 'w': p.w * (1.0::DOUBLE - {a})}} ELSE "
                f"{{'y': (p.w * (1.0::DOUBLE - {a}) * p.y + {a} * v.y) / (p.w * (1.0::DOUBLE - {a}) + {a}), 'w': 1.0::DOUBLE}} END")
        return r(f"list_reduce(LIST({{'y': {c}, 'w': 1.0::DOUBLE}}) OVER wh, {step}).y", f"{c}_ewm_{n}")
    cols = ", ".join(mean(c, n) for c in ("x", "gappy") for n in EWM_SPANS)
    return duck_with(f"""WITH s AS (SELECT restaurant_id, date, CAST(total_orders AS DOUBLE) AS x, CAST(CASE WHEN total_orders % 3 <> 0 THEN total_orders END AS DOUBLE) AS gappy FROM daily_orders)
SELECT restaurant_id, date, {cols} FROM s WINDOW wh AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "daily_orders")


def q_calendar_features(spark, sf):
    return _keyed(spark, sf, C.calendar_columns("date"))


def q_merge_context(spark, sf):
    i = load_inputs(spark, sf)
    return J.merge_context(i.daily_orders.select(*KEY), i.external_context, i.master)


def q_join_city(spark, sf):
    i = load_inputs(spark, sf)
    return J.join_city(i.daily_orders.select(*KEY, "total_orders"), i.master)


def q_behavioral_features(spark, sf):
    return rounded(X.behavioral_features(load_inputs(spark, sf).daily_orders))


def q_static_features(spark, sf):
    return rounded(X.static_features(load_inputs(spark, sf).master))


def q_feature_pipeline(spark, sf):
    i = load_inputs(spark, sf)
    return rounded(X.feature_pipeline_joined(i.daily_orders, i.external_context, i.master))


def q_context_calendar(spark, sf):
    """The context table's calendar, holiday and event columns."""
    ctx = load_inputs(spark, sf).external_context
    return ctx.select("date", "city", C.day_of_week("date").alias("day_of_week"),
                      C.is_weekend("date").alias("is_weekend"), "is_holiday", "event_flag",
                      F.month("date").cast("int").alias("month"),
                      J.weather_code("weather").alias("weather_encoded"))


def q_boolean_flags(spark, sf):
    m = load_inputs(spark, sf).master
    return m.select("restaurant_id", *[S.yes_no_flag(c).alias(c) for c in
                                       ("has_table_booking", "has_online_delivery", "is_delivering_now")])


def q_cuisine_features(spark, sf):
    m = load_inputs(spark, sf).master
    flags = S.cuisine_flags("cuisines")
    return m.select("restaurant_id", S.cuisine_count("cuisines").alias("cuisine_count"), *flags,
                    S.entropy_of_flags(flags).alias("cuisine_diversity"))


def _static_subset(spark, sf, cols):
    return rounded(X.static_features(load_inputs(spark, sf).master).select("restaurant_id", *cols))


def q_cost_features(spark, sf):
    return _static_subset(spark, sf, ["log_cost", "cost_per_price_range", "is_high_cost"])


def q_rating_features(spark, sf):
    return _static_subset(spark, sf, ["rating_tier", "is_unrated", "rating_x_votes", "rating_tier_encoded"])


def q_popularity_features(spark, sf):
    return _static_subset(spark, sf, ["log_votes", "votes_per_cuisine", "is_popular"])


def q_geo_features(spark, sf):
    return _static_subset(spark, sf, ["city", "city_restaurant_count", "city_freq", "is_india"])


def q_demand_prior(spark, sf):
    m = load_inputs(spark, sf).master
    return m.select("restaurant_id", S.demand_prior().alias("base_demand"))


def q_seasonal_index(spark, sf):
    d = load_inputs(spark, sf).daily_orders.select("date").distinct()
    return rounded(d.select("date", C.seasonal_index("date").alias("seasonal_index"),
                            C.seasonal_index("date", 0.15, 80).alias("seasonal_index_v1")))


def q_dense_spine(spark, sf):
    d = load_inputs(spark, sf).daily_orders
    return J.entity_spine(d)


def q_city_date_spine(spark, sf):
    i = load_inputs(spark, sf)
    return J.city_date_spine(i.daily_orders, i.external_context)


def q_join_entity_avg(spark, sf):
    i = load_inputs(spark, sf)
    return rounded(J.join_entity_avg(i.master, i.daily_orders)
                   .select("restaurant_id", "city", "aggregate_rating", "avg_total_orders"))


def q_leak_safe_features(spark, sf):
    """X2 with frames ending at the previous row and the target-bearing columns dropped."""
    i = load_inputs(spark, sf)
    return rounded(X.temporal_features(i.daily_orders, i.external_context, i.master, leak_safe=True))


def q_calendar_lags(spark, sf):
    """Lags over the densified (calendar-complete) series: calendar lags, not row lags."""
    dense = J.densify(load_inputs(spark, sf).daily_orders)
    return dense.select("restaurant_id", "date", "total_orders",
                        *W.lag_columns("total_orders", [1, 7], "calendar_lag_"))


def q_feature_profile(spark, sf):
    """A17 on the temporal feature table, with the feature-group labels."""
    from ..operators.explore import feature_profile
    i = load_inputs(spark, sf)
    return rounded(feature_profile(X.temporal_features(i.daily_orders, i.external_context, i.master)))


QUERIES = {
    "feature_profile": q_feature_profile,
    "leak_safe_features": q_leak_safe_features,
    "calendar_lags": q_calendar_lags,
    "temporal_features": q_temporal_features,
    "basic_features": q_basic_features,
    "order_lags": q_order_lags,
    "revenue_lags": q_revenue_lags,
    "order_rolling": q_order_rolling,
    "revenue_rolling": q_revenue_rolling,
    "trend_features": q_trend_features, "ewm_spans": q_ewm_spans,
    "calendar_features": q_calendar_features,
    "merge_context": q_merge_context,
    "join_city": q_join_city,
    "behavioral_features": q_behavioral_features,
    "static_features": q_static_features,
    "feature_pipeline": q_feature_pipeline,
    "context_calendar": q_context_calendar,
    "boolean_flags": q_boolean_flags,
    "cuisine_features": q_cuisine_features,
    "cost_features": q_cost_features,
    "rating_features": q_rating_features,
    "popularity_features": q_popularity_features,
    "geo_features": q_geo_features,
    "demand_prior": q_demand_prior,
    "seasonal_index": q_seasonal_index,
    "dense_spine": q_dense_spine,
    "city_date_spine": q_city_date_spine,
    "join_entity_avg": q_join_entity_avg,
}


# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------

_WINDOWS = """
WINDOW w AS (PARTITION BY restaurant_id ORDER BY date),
       w7 AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w14 AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
       wh AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

_DOW = "(isodow(date) - 1)"


def _calendar_sql() -> list[str]:
    return [
        f"CAST({_DOW} AS INT) AS day_of_week",
        "CAST(dayofmonth(date) AS INT) AS day_of_month",
        "CAST(dayofyear(date) AS INT) AS day_of_year",
        "CAST(weekofyear(date) AS INT) AS week",
        "CAST(month(date) AS INT) AS month",
        "CAST(quarter(date) AS INT) AS quarter",
        "CAST(year(date) AS INT) AS year",
        f"CAST({_DOW} >= 5 AS INT) AS is_weekend",
        "CAST(dayofmonth(date) = 1 AS INT) AS is_month_start",
        "CAST(date = last_day(date) AS INT) AS is_month_end",
        "CAST((dayofmonth(date) - 1) // 7 + 1 AS INT) AS week_of_month",
        r(f"sin(2 * pi() * {_DOW} / 7)", "sin_day_of_week"),
        r(f"cos(2 * pi() * {_DOW} / 7)", "cos_day_of_week"),
        r("sin(2 * pi() * (month(date) - 1) / 12)", "sin_month"),
        r("cos(2 * pi() * (month(date) - 1) / 12)", "cos_month"),
        r("sin(2 * pi() * dayofyear(date) / 365)", "sin_day_of_year"),
        r("cos(2 * pi() * dayofyear(date) / 365)", "cos_day_of_year"),
    ]


def _lags_sql(col: str, lags, prefix: str) -> list[str]:
    return [r(f"LAG({col}, {k}) OVER w", f"{prefix}{k}") for k in lags]


def _rolling_sql() -> list[str]:
    out = []
    for n in W.ROLLING_WINDOWS:
        out += [
            r(f"AVG(total_orders) OVER w{n}", f"orders_rmean_{n}"),
            r(f"STDDEV_SAMP(total_orders) OVER w{n}", f"orders_rstd_{n}"),
            r(f"MIN(total_orders) OVER w{n}", f"orders_rmin_{n}"),
            r(f"MAX(total_orders) OVER w{n}", f"orders_rmax_{n}"),
        ]
    return out


def _revenue_rolling_sql() -> list[str]:
    return [r(f"AVG(total_revenue) OVER w{n}", f"revenue_rmean_{n}") for n in W.REVENUE_ROLLING_WINDOWS]


def _trend_sql() -> list[str]:
    ewm = ("list_reduce(LIST(CAST(total_orders AS DOUBLE)) OVER wh, "
           "lambda a, v: a * CAST(0.75 AS DOUBLE) + v * CAST(0.25 AS DOUBLE))")
    return [
        r("total_orders - LAG(total_orders, 1) OVER w", "orders_diff_1"),
        r("total_orders - LAG(total_orders, 7) OVER w", "orders_diff_7"),
        r("total_revenue - LAG(total_revenue, 1) OVER w", "revenue_diff_1"),
        r("(total_orders - AVG(total_orders) OVER w7) / (AVG(total_orders) OVER w7 + 1)", "orders_momentum_7"),
        r(ewm, "orders_ewm_7"),
    ]


def _daily_rounded() -> list[str]:
    return ["restaurant_id", "date", "total_orders", r("total_revenue", "total_revenue"),
            r("avg_discount", "avg_discount"), "promotion_flag",
            r("cancellation_rate", "cancellation_rate"), r("avg_delivery_time", "avg_delivery_time")]


def _temporal_window_sql() -> str:
    cols = (_daily_rounded() + _calendar_sql()
            + _lags_sql("total_orders", W.ORDER_LAGS, "orders_lag_")
            + _lags_sql("total_revenue", W.REVENUE_LAGS, "revenue_lag_")
            + _rolling_sql() + _revenue_rolling_sql() + _trend_sql())
    return "SELECT " + ",\n  ".join(cols) + "\nFROM daily_orders\n" + _WINDOWS


_CONTEXT_JOIN = """
LEFT JOIN (SELECT DISTINCT restaurant_id, city FROM master) cm ON cm.restaurant_id = f.restaurant_id
LEFT JOIN external_context c ON c.date = f.date AND c.city = cm.city
"""
_CONTEXT_COLS = """COALESCE(CAST(c.is_holiday AS INT), 0) AS is_holiday,
  COALESCE(CAST(c.event_flag AS INT), 0) AS event_flag,
  CAST(CASE c.weather WHEN 'Clear' THEN 0 WHEN 'Cloudy' THEN 1 WHEN 'Rainy' THEN 2
       WHEN 'Snowy' THEN 3 WHEN 'Stormy' THEN 4 WHEN 'Unknown' THEN 5 ELSE 5 END AS INT) AS weather_encoded"""


def o_temporal_features() -> str:
    body = f"WITH f AS ({_temporal_window_sql()})\nSELECT f.*, {_CONTEXT_COLS}\nFROM f {_CONTEXT_JOIN}"
    return duck_with(body, "daily_orders", "master", "external_context")


def o_basic_features() -> str:
    cols = _daily_rounded() + [
        f"CAST({_DOW} AS INT) AS day_of_week", "CAST(weekofyear(date) AS INT) AS week",
        "CAST(month(date) AS INT) AS month", "CAST(year(date) AS INT) AS year",
        f"CAST({_DOW} >= 5 AS INT) AS is_weekend",
    ] + _lags_sql("total_orders", W.BASIC_LAGS, "lag_") + [
        r("CASE WHEN COUNT(total_orders) OVER w7 >= 7 THEN AVG(total_orders) OVER w7 END", "rolling_mean_7"),
        r("CASE WHEN COUNT(total_orders) OVER w7 >= 7 THEN STDDEV_SAMP(total_orders) OVER w7 END", "rolling_std_7"),
    ]
    return duck_with("SELECT " + ",\n ".join(cols) + "\nFROM daily_orders\n" + _WINDOWS, "daily_orders")


def _keyed_sql(cols: list[str]) -> str:
    return duck_with("SELECT restaurant_id, date, " + ",\n ".join(cols) + "\nFROM daily_orders\n" + _WINDOWS,
                     "daily_orders")


def o_merge_context() -> str:
    body = (f"SELECT f.restaurant_id, f.date, {_CONTEXT_COLS}\n"
            f"FROM (SELECT restaurant_id, date FROM daily_orders) f {_CONTEXT_JOIN}")
    return duck_with(body, "daily_orders", "master", "external_context")


def o_join_city() -> str:
    body = ("SELECT d.restaurant_id, d.date, d.total_orders, cm.city FROM daily_orders d "
            "LEFT JOIN (SELECT DISTINCT restaurant_id, city FROM master) cm USING (restaurant_id)")
    return duck_with(body, "daily_orders", "master")


def o_behavioral_features() -> str:
    body = f"""SELECT restaurant_id,
  {r('AVG(CAST(promotion_flag AS INT))', 'promotion_usage_rate')},
  {r('AVG(cancellation_rate)', 'avg_cancellation_rate')},
  {r('AVG(avg_delivery_time)', 'avg_delivery_time')},
  {r('AVG(total_orders)', 'avg_orders_per_day')}
FROM daily_orders WHERE restaurant_id IS NOT NULL GROUP BY restaurant_id"""
    return duck_with(body, "daily_orders")


_FLAG_NAMES = list(S.CUISINE_FLAGS.values())


def _cuisine_sql() -> str:
    low = "lower(COALESCE(cuisines, ''))"
    flags = [f"CAST(contains({low}, '{c.lower()}') AS INT) AS {flag}" for c, flag in S.CUISINE_FLAGS.items()]
    count = ("CAST(len(list_filter(list_transform(string_split(COALESCE(cuisines, ''), ','), "
             "lambda x: trim(x)), lambda x: x <> '')) AS INT) AS cuisine_count")
    return ",\n ".join([count] + flags)


def _static_base_sql() -> str:
    k = " + ".join(_FLAG_NAMES)
    return f"""s0 AS (
  SELECT restaurant_id, country_code, city, longitude, latitude, average_cost_for_two,
    CASE WHEN has_table_booking IN ('Yes', 'yes') THEN 1 ELSE 0 END AS has_table_booking,
    CASE WHEN has_online_delivery IN ('Yes', 'yes') THEN 1 ELSE 0 END AS has_online_delivery,
    CASE WHEN is_delivering_now IN ('Yes', 'yes') THEN 1 ELSE 0 END AS is_delivering_now,
    price_range, aggregate_rating, votes,
    {_cuisine_sql()}
  FROM master),
q AS (SELECT quantile_cont(average_cost_for_two, 0.75) AS cost_q75,
             quantile_cont(CAST(votes AS DOUBLE), 0.75) AS votes_q75, COUNT(*) AS n_rows FROM master),
cc AS (SELECT city, COUNT(*) AS city_restaurant_count FROM master WHERE city IS NOT NULL GROUP BY city),
s AS (
  SELECT s0.*,
    abs(round_even(CASE WHEN ({k}) > 1 THEN log2({k}) ELSE 0 END, 4)) AS cuisine_diversity,
    ln(1 + greatest(COALESCE(average_cost_for_two, 0), 0)) AS log_cost,
    CASE WHEN price_range > 0 THEN average_cost_for_two / price_range ELSE 0 END AS cost_per_price_range,
    CAST(COALESCE(average_cost_for_two > q.cost_q75, false) AS INT) AS is_high_cost,
    CASE WHEN aggregate_rating = 0 THEN 'unrated' WHEN aggregate_rating < 2.5 THEN 'poor'
         WHEN aggregate_rating < 3.5 THEN 'average' WHEN aggregate_rating < 4.0 THEN 'good'
         ELSE 'excellent' END AS rating_tier,
    CAST(COALESCE(aggregate_rating = 0, false) AS INT) AS is_unrated,
    aggregate_rating * ln(1 + greatest(COALESCE(CAST(votes AS DOUBLE), 0), 0)) AS rating_x_votes,
    ln(1 + greatest(COALESCE(CAST(votes AS DOUBLE), 0), 0)) AS log_votes,
    CASE WHEN cuisine_count > 0 THEN votes / cuisine_count ELSE 0 END AS votes_per_cuisine,
    CAST(COALESCE(votes > q.votes_q75, false) AS INT) AS is_popular,
    cc.city_restaurant_count,
    cc.city_restaurant_count / q.n_rows AS city_freq,
    CAST(COALESCE(country_code = 1, false) AS INT) AS is_india
  FROM s0 CROSS JOIN q LEFT JOIN cc USING (city))"""


def o_static_features() -> str:
    dbl = ["longitude", "latitude", "average_cost_for_two", "aggregate_rating", "cuisine_diversity",
           "log_cost", "cost_per_price_range", "rating_x_votes", "log_votes", "votes_per_cuisine", "city_freq"]
    cols = ["restaurant_id", "country_code", "city", "has_table_booking", "has_online_delivery",
            "is_delivering_now", "price_range", "aggregate_rating", "votes", "cuisine_count"] + _FLAG_NAMES + [
        "cuisine_diversity", "log_cost", "cost_per_price_range", "is_high_cost", "rating_tier", "is_unrated",
        "rating_x_votes", "log_votes", "votes_per_cuisine", "is_popular", "city_restaurant_count",
        "city_freq", "is_india", "longitude", "latitude", "average_cost_for_two"]
    sel = [r(c, c) if c in dbl else c for c in cols]
    sel.append("CAST(CASE rating_tier WHEN 'unrated' THEN 0 WHEN 'poor' THEN 1 WHEN 'average' THEN 2 "
               "WHEN 'good' THEN 3 WHEN 'excellent' THEN 4 ELSE 0 END AS INT) AS rating_tier_encoded")
    body = f"WITH {_static_base_sql()}\nSELECT " + ", ".join(sel) + " FROM s"
    return duck_with(body, "master")


def _static_subset_sql(cols: list[str], dbl: list[str]) -> str:
    sel = ["restaurant_id"] + [r(c, c) if c in dbl else c for c in cols]
    body = f"WITH {_static_base_sql()}\nSELECT " + ", ".join(sel) + " FROM s"
    return duck_with(body, "master")


def o_rating_features() -> str:
    sel = ["restaurant_id", "rating_tier", "is_unrated", r("rating_x_votes", "rating_x_votes"),
           "CAST(CASE rating_tier WHEN 'unrated' THEN 0 WHEN 'poor' THEN 1 WHEN 'average' THEN 2 "
           "WHEN 'good' THEN 3 WHEN 'excellent' THEN 4 ELSE 0 END AS INT) AS rating_tier_encoded"]
    return duck_with(f"WITH {_static_base_sql()}\nSELECT " + ", ".join(sel) + " FROM s", "master")


def o_feature_pipeline() -> str:
    body = f"""WITH f AS ({_temporal_window_sql()}),
t AS (SELECT f.*, {_CONTEXT_COLS} FROM f {_CONTEXT_JOIN}),
b AS (SELECT restaurant_id,
  {r('AVG(CAST(promotion_flag AS INT))', 'entity_promotion_usage_rate')},
  {r('AVG(cancellation_rate)', 'entity_avg_cancellation_rate')},
  {r('AVG(avg_delivery_time)', 'entity_avg_delivery_time')},
  {r('AVG(total_orders)', 'entity_avg_orders_per_day')}
  FROM daily_orders WHERE restaurant_id IS NOT NULL GROUP BY restaurant_id)
SELECT t.*, b.entity_promotion_usage_rate, b.entity_avg_cancellation_rate,
       b.entity_avg_delivery_time, b.entity_avg_orders_per_day
FROM t LEFT JOIN b ON b.restaurant_id = t.restaurant_id"""
    return duck_with(body, "daily_orders", "master", "external_context")


def o_context_calendar() -> str:
    body = f"""SELECT date, city, CAST({_DOW} AS INT) AS day_of_week, CAST({_DOW} >= 5 AS INT) AS is_weekend,
  is_holiday, event_flag, CAST(month(date) AS INT) AS month,
  CAST(CASE weather WHEN 'Clear' THEN 0 WHEN 'Cloudy' THEN 1 WHEN 'Rainy' THEN 2
       WHEN 'Snowy' THEN 3 WHEN 'Stormy' THEN 4 ELSE 5 END AS INT) AS weather_encoded
FROM external_context"""
    return duck_with(body, "external_context")


def o_boolean_flags() -> str:
    body = """SELECT restaurant_id,
  CASE WHEN has_table_booking IN ('Yes', 'yes') THEN 1 ELSE 0 END AS has_table_booking,
  CASE WHEN has_online_delivery IN ('Yes', 'yes') THEN 1 ELSE 0 END AS has_online_delivery,
  CASE WHEN is_delivering_now IN ('Yes', 'yes') THEN 1 ELSE 0 END AS is_delivering_now
FROM master"""
    return duck_with(body, "master")


def o_cuisine_features() -> str:
    k = " + ".join(_FLAG_NAMES)
    body = f"""WITH s0 AS (SELECT restaurant_id, {_cuisine_sql()} FROM master)
SELECT restaurant_id, cuisine_count, {", ".join(_FLAG_NAMES)},
  abs(round_even(CASE WHEN ({k}) > 1 THEN log2({k}) ELSE 0 END, 4)) AS cuisine_diversity
FROM s0"""
    return duck_with(body, "master")


def o_demand_prior() -> str:
    body = """SELECT restaurant_id,
  CAST(greatest(round_even(20.0
    * CASE price_range WHEN 1 THEN 1.4 WHEN 2 THEN 1.1 WHEN 3 THEN 0.85 WHEN 4 THEN 0.65 ELSE 1.0 END
    * CASE WHEN aggregate_rating = 0 THEN 0.5 ELSE 0.4 + aggregate_rating / 5.0 END
    * least(0.6 + 0.25 * ln(1 + greatest(CAST(votes AS DOUBLE), 1.0)) / ln(1001.0), 1.8)
    * CASE WHEN lower(trim(has_online_delivery)) IN ('yes', 'true') THEN 2.0 ELSE 0.8 END, 0), 1.0) AS BIGINT)
    AS base_demand
FROM master"""
    return duck_with(body, "master")


def o_seasonal_index() -> str:
    body = f"""SELECT date,
  {r('1 + 0.10 * sin(2 * pi() * (dayofyear(date) - 280) / 365)', 'seasonal_index')},
  {r('1 + 0.15 * sin(2 * pi() * (dayofyear(date) - 80) / 365)', 'seasonal_index_v1')}
FROM (SELECT DISTINCT date FROM daily_orders)"""
    return duck_with(body, "daily_orders")


def o_dense_spine() -> str:
    body = """SELECT restaurant_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT restaurant_id, MIN(date) AS d0, MAX(date) AS d1 FROM daily_orders GROUP BY restaurant_id)"""
    return duck_with(body, "daily_orders")


def o_city_date_spine() -> str:
    body = """SELECT c.city, CAST(unnest(generate_series(b.d0, b.d1, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT DISTINCT city FROM external_context WHERE city IS NOT NULL) c,
     (SELECT MIN(date) AS d0, MAX(date) AS d1 FROM daily_orders) b"""
    return duck_with(body, "daily_orders", "external_context")


def o_join_entity_avg() -> str:
    body = f"""SELECT m.restaurant_id, m.city, {r('m.aggregate_rating', 'aggregate_rating')},
  {r('a.avg_total_orders', 'avg_total_orders')}
FROM master m JOIN (SELECT restaurant_id, AVG(total_orders) AS avg_total_orders
                    FROM daily_orders GROUP BY restaurant_id) a USING (restaurant_id)"""
    return duck_with(body, "daily_orders", "master")


_WINDOWS_SAFE = """
WINDOW w AS (PARTITION BY restaurant_id ORDER BY date),
       w7 AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w14 AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
       w30 AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
       wh AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""


def o_leak_safe_features() -> str:
    ewm = ("list_reduce(LIST(CAST(total_orders AS DOUBLE)) OVER wh, "
           "lambda a, v: a * CAST(0.75 AS DOUBLE) + v * CAST(0.25 AS DOUBLE))")
    cols = (_daily_rounded() + _calendar_sql()
            + _lags_sql("total_orders", W.ORDER_LAGS, "orders_lag_")
            + _lags_sql("total_revenue", W.REVENUE_LAGS, "revenue_lag_")
            + _rolling_sql() + _revenue_rolling_sql() + [r(ewm, "orders_ewm_7")])
    win = "SELECT " + ",\n  ".join(cols) + "\nFROM daily_orders\n" + _WINDOWS_SAFE
    body = f"WITH f AS ({win})\nSELECT f.*, {_CONTEXT_COLS}\nFROM f {_CONTEXT_JOIN}"
    return duck_with(body, "daily_orders", "master", "external_context")


def o_calendar_lags() -> str:
    body = """WITH s AS (SELECT restaurant_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT restaurant_id, MIN(date) AS d0, MAX(date) AS d1 FROM daily_orders GROUP BY restaurant_id))
SELECT s.restaurant_id, s.date, d.total_orders,
  CAST(LAG(d.total_orders, 1) OVER w AS DOUBLE) AS calendar_lag_1,
  CAST(LAG(d.total_orders, 7) OVER w AS DOUBLE) AS calendar_lag_7
FROM s LEFT JOIN daily_orders d ON d.restaurant_id = s.restaurant_id AND d.date = s.date
WINDOW w AS (PARTITION BY s.restaurant_id ORDER BY s.date)"""
    return duck_with(body, "daily_orders")


def o_feature_profile() -> str:
    from ..operators.explore import feature_group
    cols = [c.split(" AS ")[-1].strip() for c in _daily_rounded() + _calendar_sql()
            + _lags_sql("total_orders", W.ORDER_LAGS, "orders_lag_")
            + _lags_sql("total_revenue", W.REVENUE_LAGS, "revenue_lag_")
            + _rolling_sql() + _revenue_rolling_sql() + _trend_sql()] + ["is_holiday", "event_flag", "weather_encoded"]
    types = {"restaurant_id": "bigint", "date": "date", "total_orders": "bigint", "promotion_flag": "boolean"}
    ints = {"day_of_week", "day_of_month", "day_of_year", "week", "month", "quarter", "year", "is_weekend",
            "is_month_start", "is_month_end", "week_of_month", "is_holiday", "event_flag", "weather_encoded"}
    parts = []
    for c in cols:
        t = types.get(c, "int" if c in ints else "double")
        parts.append(f"SELECT '{c}' AS column, '{feature_group(c)}' AS feature_group, '{t}' AS dtype, "
                     f"COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null, "
                     f"{r(f'COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*)', 'null_pct')} FROM t")
    body = (f"WITH f AS ({_temporal_window_sql()}),\nt AS MATERIALIZED (SELECT f.*, {_CONTEXT_COLS} FROM f "
            f"{_CONTEXT_JOIN})\n" + "\nUNION ALL ".join(parts))
    return duck_with(body, "daily_orders", "master", "external_context")


def oracles() -> dict[str, str]:
    return {
        "feature_profile": o_feature_profile(),
        "leak_safe_features": o_leak_safe_features(),
        "calendar_lags": o_calendar_lags(),
        "temporal_features": o_temporal_features(),
        "basic_features": o_basic_features(),
        "order_lags": _keyed_sql(_lags_sql("total_orders", W.ORDER_LAGS, "orders_lag_")),
        "revenue_lags": _keyed_sql(_lags_sql("total_revenue", W.REVENUE_LAGS, "revenue_lag_")),
        "order_rolling": _keyed_sql(_rolling_sql()),
        "revenue_rolling": _keyed_sql(_revenue_rolling_sql()),
        "trend_features": _keyed_sql(_trend_sql()), "ewm_spans": o_ewm_spans(),
        "calendar_features": _keyed_sql(_calendar_sql()),
        "merge_context": o_merge_context(),
        "join_city": o_join_city(),
        "behavioral_features": o_behavioral_features(),
        "static_features": o_static_features(),
        "feature_pipeline": o_feature_pipeline(),
        "context_calendar": o_context_calendar(),
        "boolean_flags": o_boolean_flags(),
        "cuisine_features": o_cuisine_features(),
        "cost_features": _static_subset_sql(["log_cost", "cost_per_price_range", "is_high_cost"],
                                            ["log_cost", "cost_per_price_range"]),
        "rating_features": o_rating_features(),
        "popularity_features": _static_subset_sql(["log_votes", "votes_per_cuisine", "is_popular"],
                                                  ["log_votes", "votes_per_cuisine"]),
        "geo_features": _static_subset_sql(["city", "city_restaurant_count", "city_freq", "is_india"],
                                           ["city_freq"]),
        "demand_prior": o_demand_prior(),
        "seasonal_index": o_seasonal_index(),
        "dense_spine": o_dense_spine(),
        "city_date_spine": o_city_date_spine(),
        "join_entity_avg": o_join_entity_avg(),
    }

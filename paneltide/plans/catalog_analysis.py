"""Registered exploratory, quality, statistics, split, evaluation and risk queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import correlation as C
from ..operators import evaluate as E
from ..operators import explore as A
from ..operators import joins as J
from ..operators import quality as D
from ..operators import risk as R
from ..operators import split as SP
from ..sources.bindings import duck_with, load_inputs
from . import features as X
from .common import r, rounded

AS_OF_DATE = "2001-12-31"


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def _scored(spark: SparkSession, sf: str) -> DataFrame:
    i = load_inputs(spark, sf)
    p = i.predictions
    lo, hi = R.bounded("prediction", "lower_bound", "upper_bound")
    p = p.select("restaurant_id", "date", "total_orders", "prediction",
                 lo.alias("lower_bound"), hi.alias("upper_bound"))
    return R.score(p)


def _scored_days(spark: SparkSession, sf: str) -> DataFrame:
    i = load_inputs(spark, sf)
    return R.with_day_info(_scored(spark, sf), i.external_context, i.master)


_SCORED_SQL = """
scored AS (
  SELECT restaurant_id, date, total_orders, prediction, lower_bound, upper_bound,
    (upper_bound - lower_bound) / (prediction + 1) AS risk_score,
    CASE WHEN (upper_bound - lower_bound) / (prediction + 1) < 0.2 THEN 'Low Risk'
         WHEN (upper_bound - lower_bound) / (prediction + 1) < 0.5 THEN 'Medium Risk'
         ELSE 'High Risk' END AS risk_level,
    abs(total_orders - prediction) AS abs_error,
    upper_bound - lower_bound AS interval_width,
    CAST(total_orders >= lower_bound AND total_orders <= upper_bound AS INT) AS within_interval
  FROM (SELECT restaurant_id, date, total_orders, prediction,
               least(lower_bound, prediction) AS lower_bound,
               greatest(upper_bound, prediction) AS upper_bound FROM predictions)),
scored_days AS (
  SELECT s.*, COALESCE(CAST(h.is_holiday AS INT), 0) AS is_holiday,
    dayname(s.date) AS day_name, CAST(isodow(s.date) - 1 AS INT) AS day_of_week,
    CASE WHEN COALESCE(CAST(h.is_holiday AS INT), 0) = 1 THEN 'Holiday' ELSE 'Regular Day' END AS day_type
  FROM scored s
  LEFT JOIN (SELECT DISTINCT restaurant_id, city FROM master) cm ON cm.restaurant_id = s.restaurant_id
  LEFT JOIN (SELECT DISTINCT date, city, is_holiday FROM external_context) h
         ON h.date = s.date AND h.city = cm.city)
"""


def _with_scored(body: str, days: bool = False) -> str:
    # scored_days refers to master and the context, so they are always bound
    return duck_with(f"WITH {_SCORED_SQL.strip()}\n{body}", "predictions", "master", "external_context")


_CTX_JOIN_SQL = """(SELECT d.*, e.weather, e.is_holiday, e.event_flag FROM daily_orders d
  LEFT JOIN (SELECT DISTINCT restaurant_id, city FROM master) cm ON cm.restaurant_id = d.restaurant_id
  JOIN external_context e ON e.date = d.date AND e.city = cm.city)"""


# ---------------------------------------------------------------------------
# A / O ops
# ---------------------------------------------------------------------------

def q_daily_trend(spark, sf):
    return A.daily_trend(load_inputs(spark, sf).daily_orders)


def q_dow_pattern(spark, sf):
    return rounded(A.dow_pattern(load_inputs(spark, sf).daily_orders))


def q_weekend_pattern(spark, sf):
    return rounded(A.weekend_pattern(load_inputs(spark, sf).daily_orders))


def q_monthly_seasonality(spark, sf):
    return A.monthly_seasonality(load_inputs(spark, sf).daily_orders)


def q_value_counts(spark, sf):
    return rounded(A.value_counts(load_inputs(spark, sf).master, "city"))


def q_weather_impact(spark, sf):
    i = load_inputs(spark, sf)
    return rounded(A.weather_impact(i.daily_orders, i.external_context, i.master))


def q_promotion_impact(spark, sf):
    return rounded(A.promotion_impact(load_inputs(spark, sf).daily_orders))


def q_flag_impact(spark, sf):
    i = load_inputs(spark, sf)
    return rounded(A.flag_impact(i.daily_orders, i.external_context, i.master))


def q_binned_mean_cancel(spark, sf):
    d = load_inputs(spark, sf).daily_orders
    return rounded(A.binned_mean(d, "cancellation_rate", A.CANCEL_BINS, A.CANCEL_LABELS, "total_orders"))


def q_binned_mean_rating(spark, sf):
    i = load_inputs(spark, sf)
    j = J.join_entity_avg(i.master, i.daily_orders)
    return rounded(A.binned_mean(j, "aggregate_rating", A.RATING_BINS, A.RATING_LABELS, "avg_total_orders"))


def q_box_stats(spark, sf):
    from ..functions.scalar import right_closed_bin
    d = load_inputs(spark, sf).daily_orders
    label, _ = right_closed_bin("avg_discount", A.DISCOUNT_BINS, A.DISCOUNT_LABELS)
    return rounded(A.box_stats(d.where(label.isNotNull()), label, "total_orders"))


def q_flag_attr_means(spark, sf):
    i = load_inputs(spark, sf)
    return rounded(A.flag_attr_means(i.master, i.daily_orders))


def q_histogram(spark, sf):
    return rounded(A.histogram(load_inputs(spark, sf).daily_orders, "total_revenue", 20))


DESCRIBE_COLUMNS = ["restaurant_id", "total_orders", "total_revenue", "avg_discount",
                    "cancellation_rate", "avg_delivery_time"]


def q_describe_numeric(spark, sf):
    return rounded(A.describe_numeric(load_inputs(spark, sf).daily_orders, DESCRIBE_COLUMNS))


def q_describe_numeric_ranked(spark, sf):
    """A16 again: kept from when the ranked quantiles were a second path."""
    return rounded(A.describe_numeric(load_inputs(spark, sf).daily_orders, DESCRIBE_COLUMNS))


def q_iqr_outliers_ranked(spark, sf):
    return rounded(D.iqr_outliers(load_inputs(spark, sf).daily_orders, ["total_orders", "total_revenue"]))


def q_profile_columns(spark, sf):
    return rounded(A.profile_columns(load_inputs(spark, sf).daily_orders))


def q_dataset_summary(spark, sf):
    return rounded(A.dataset_summary(load_inputs(spark, sf).daily_orders))


def q_entity_metric_summary(spark, sf):
    perf = E.entity_performance(load_inputs(spark, sf).predictions)
    return rounded(A.metric_summary(perf, "rmse"))


def q_top_bottom_entities(spark, sf):
    return A.top_bottom(A.entity_totals(load_inputs(spark, sf).daily_orders), "sum_total_orders", 5)


def q_entity_best_worst(spark, sf):
    perf = E.entity_performance(load_inputs(spark, sf).predictions)
    best = perf.orderBy(F.col("rmse").asc(), "restaurant_id").limit(5).withColumn("category", F.lit("best"))
    worst = perf.orderBy(F.col("rmse").desc(), "restaurant_id").limit(5).withColumn("category", F.lit("worst"))
    return rounded(best.unionByName(worst))


def q_top_categories(spark, sf):
    return A.top_categories(load_inputs(spark, sf).master, "city", 10)


# ---------------------------------------------------------------------------
# D ops
# ---------------------------------------------------------------------------

def q_quality_report(spark, sf):
    i = load_inputs(spark, sf)
    return rounded(D.quality_report(i.master, i.daily_orders, i.external_context))


def q_missing_values(spark, sf):
    i = load_inputs(spark, sf)
    return reduce(DataFrame.unionByName, [D.missing_by_column(i.master, "restaurants"),
                                          D.missing_by_column(i.daily_orders, "daily_orders"),
                                          D.missing_by_column(i.external_context, "external_context")])


def q_duplicate_ids(spark, sf):
    return D.duplicate_ids(load_inputs(spark, sf).master)


def q_date_continuity(spark, sf):
    return D.date_continuity(load_inputs(spark, sf).daily_orders)


def q_missing_dates(spark, sf):
    return D.missing_dates(load_inputs(spark, sf).daily_orders)


def q_iqr_outliers(spark, sf):
    return rounded(D.iqr_outliers(load_inputs(spark, sf).daily_orders, ["total_orders", "total_revenue"]))


def q_negative_values(spark, sf):
    return D.negative_values(load_inputs(spark, sf).daily_orders,
                             ["total_orders", "total_revenue", "avg_discount", "avg_delivery_time"])


def q_validate_master(spark, sf):
    return D.rule_counts(D.validate(load_inputs(spark, sf).master, D.master_rules()))


def q_validate_orders(spark, sf):
    return D.rule_counts(D.validate(load_inputs(spark, sf).daily_orders, D.orders_rules(AS_OF_DATE)))


def q_validate_context(spark, sf):
    return D.rule_counts(D.validate(load_inputs(spark, sf).external_context, D.context_rules()))


#: Fixed value: the day of the order records' check, before the end of the series, so that later rows are quarantined.
RECORDS_AS_OF = "1997-06-30"


def q_master_records(spark, sf):
    """Master records, valid ones trimmed and defaulted."""
    out = D.records(load_inputs(spark, sf).master, D.master_rules(), D.clean_master)
    return rounded(out.withColumn("violations", F.array_join("violations", ",")))


def q_order_records(spark, sf):
    """Daily records as of a day inside the series; later ones are quarantined."""
    out = D.records(load_inputs(spark, sf).daily_orders, D.orders_rules(RECORDS_AS_OF), D.clean_orders)
    return rounded(out.withColumn("violations", F.array_join("violations", ",")))


def q_context_records(spark, sf):
    """Context records, valid ones trimmed and defaulted."""
    out = D.records(load_inputs(spark, sf).external_context, D.context_rules(), D.clean_context)
    return out.withColumn("violations", F.array_join("violations", ","))


def q_dataset_checks(spark, sf):
    i = load_inputs(spark, sf)
    return D.dataset_checks(i.daily_orders, i.master)


def q_pattern_lift(spark, sf):
    i = load_inputs(spark, sf)
    return rounded(D.pattern_lift(i.daily_orders, i.external_context))


def q_geo_grid(spark, sf):
    return D.geo_grid(load_inputs(spark, sf).master, 10.0)


# ---------------------------------------------------------------------------
# C ops
# ---------------------------------------------------------------------------

PEARSON_COLUMNS = ["total_orders", "total_revenue", "avg_discount", "cancellation_rate", "avg_delivery_time"]
BASIC_NUMERIC = ["lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_std_7", "total_revenue",
                 "avg_discount", "cancellation_rate", "avg_delivery_time", "day_of_week", "month", "is_weekend"]


def q_pearson_matrix(spark, sf):
    return rounded(C.pearson_matrix(load_inputs(spark, sf).daily_orders, PEARSON_COLUMNS))


def q_target_correlation(spark, sf):
    b = X.basic_features(load_inputs(spark, sf).daily_orders)
    return rounded(C.target_correlation(b, "total_orders", BASIC_NUMERIC, top=12))


def q_target_spearman(spark, sf):
    b = X.basic_features(load_inputs(spark, sf).daily_orders)
    return rounded(C.target_spearman(b, "total_orders", ["lag_1", "lag_7", "avg_discount", "avg_delivery_time"]))


def q_pearson_test(spark, sf):
    return rounded(C.pearson_test(load_inputs(spark, sf).daily_orders, "avg_delivery_time", "total_orders"))


def q_mann_whitney(spark, sf):
    return rounded(C.mann_whitney(_scored_days(spark, sf), "risk_score", "is_holiday", 1))


def q_simple_regression(spark, sf):
    return rounded(C.simple_regression(load_inputs(spark, sf).daily_orders, "total_orders", "avg_delivery_time"))


# ---------------------------------------------------------------------------
# O8/O9/E8 splits
# ---------------------------------------------------------------------------

def q_time_split(spark, sf):
    return SP.time_split(load_inputs(spark, sf).daily_orders.select("restaurant_id", "date"))


def q_entity_split(spark, sf):
    return SP.entity_split(load_inputs(spark, sf).daily_orders.select("restaurant_id", "date"))


def q_time_folds(spark, sf):
    return SP.time_folds(load_inputs(spark, sf).daily_orders, 5)


# ---------------------------------------------------------------------------
# E ops
# ---------------------------------------------------------------------------

def q_regression_metrics(spark, sf):
    return rounded(E.regression_metrics(load_inputs(spark, sf).predictions))


def q_pinball_loss(spark, sf):
    p = load_inputs(spark, sf).predictions
    return rounded(E.pinball_loss(p, [0.1, 0.5, 0.9], quantile_cols={0.1: "lower_bound", 0.5: "prediction",
                                                                     0.9: "upper_bound"}))


def q_entity_performance(spark, sf):
    return rounded(E.entity_performance(load_inputs(spark, sf).predictions))


def q_interval_coverage(spark, sf):
    return rounded(E.interval_coverage(load_inputs(spark, sf).predictions))


def q_eval_two_tables(spark, sf):
    i = load_inputs(spark, sf)
    return rounded(J.eval_two_tables(i.daily_orders, i.predictions))


# ---------------------------------------------------------------------------
# R ops
# ---------------------------------------------------------------------------

def q_bounded_forecast(spark, sf):
    s = _scored(spark, sf)
    return rounded(s.select("restaurant_id", "date", "prediction", "lower_bound", "upper_bound"))


def q_risk_scores(spark, sf):
    return rounded(_scored(spark, sf).select("restaurant_id", "date", "risk_score", "risk_level"))


def q_risk_by_entity(spark, sf):
    return rounded(R.risk_by_entity(_scored(spark, sf)))


def q_riskiest_entities(spark, sf):
    return rounded(R.riskiest_entities(_scored(spark, sf), 10))


def q_risk_by_dow(spark, sf):
    return rounded(R.risk_by_dow(_scored_days(spark, sf)))


def q_risk_crosstab_entity(spark, sf):
    s = _scored(spark, sf)
    top30 = R.risk_by_entity(s).orderBy(F.col("avg_risk").desc_nulls_last(), "restaurant_id").limit(30)
    return rounded(R.risk_crosstab(s.join(top30.select("restaurant_id"), "restaurant_id", "left_semi"),
                                   "restaurant_id"))


def q_risk_crosstab_dow(spark, sf):
    return rounded(R.risk_crosstab(_scored_days(spark, sf), "day_name"))


def q_risk_crosstab_daytype(spark, sf):
    return rounded(R.risk_crosstab(_scored_days(spark, sf), "day_type"))


def q_risk_by_daytype(spark, sf):
    return rounded(A.describe_by(_scored_days(spark, sf), "day_type", "risk_score"))


def q_risk_by_daytype_ranked(spark, sf):
    """A8 with the distributed exact median (the path beyond the size check)."""
    return rounded(A.describe_by(_scored_days(spark, sf), "day_type", "risk_score"))


def q_risk_holiday_summary(spark, sf):
    return rounded(R.risk_holiday_summary(_scored_days(spark, sf)))


def q_risk_validation_summary(spark, sf):
    return rounded(R.validation_summary(_scored(spark, sf)))


def q_risk_checks(spark, sf):
    return rounded(R.risk_checks(_scored(spark, sf)))


QUERIES = {
    "daily_trend": q_daily_trend, "dow_pattern": q_dow_pattern, "weekend_pattern": q_weekend_pattern,
    "monthly_seasonality": q_monthly_seasonality, "value_counts": q_value_counts,
    "weather_impact": q_weather_impact, "promotion_impact": q_promotion_impact, "flag_impact": q_flag_impact,
    "binned_mean_cancel": q_binned_mean_cancel, "binned_mean_rating": q_binned_mean_rating,
    "box_stats": q_box_stats, "flag_attr_means": q_flag_attr_means, "histogram": q_histogram,
    "describe_numeric": q_describe_numeric, "describe_numeric_ranked": q_describe_numeric_ranked,
    "iqr_outliers_ranked": q_iqr_outliers_ranked, "profile_columns": q_profile_columns,
    "dataset_summary": q_dataset_summary, "entity_metric_summary": q_entity_metric_summary,
    "top_bottom_entities": q_top_bottom_entities, "entity_best_worst": q_entity_best_worst,
    "top_categories": q_top_categories,
    "quality_report": q_quality_report, "missing_values": q_missing_values, "duplicate_ids": q_duplicate_ids,
    "date_continuity": q_date_continuity, "missing_dates": q_missing_dates, "iqr_outliers": q_iqr_outliers,
    "negative_values": q_negative_values, "validate_master": q_validate_master,
    "master_records": q_master_records, "order_records": q_order_records, "context_records": q_context_records,
    "validate_orders": q_validate_orders, "validate_context": q_validate_context,
    "dataset_checks": q_dataset_checks, "pattern_lift": q_pattern_lift, "geo_grid": q_geo_grid,
    "pearson_matrix": q_pearson_matrix, "target_correlation": q_target_correlation,
    "target_spearman": q_target_spearman, "pearson_test": q_pearson_test, "mann_whitney": q_mann_whitney,
    "simple_regression": q_simple_regression,
    "time_split": q_time_split, "entity_split": q_entity_split, "time_folds": q_time_folds,
    "regression_metrics": q_regression_metrics, "pinball_loss": q_pinball_loss,
    "entity_performance": q_entity_performance, "interval_coverage": q_interval_coverage,
    "eval_two_tables": q_eval_two_tables,
    "bounded_forecast": q_bounded_forecast, "risk_scores": q_risk_scores, "risk_by_entity": q_risk_by_entity,
    "riskiest_entities": q_riskiest_entities, "risk_by_dow": q_risk_by_dow,
    "risk_crosstab_entity": q_risk_crosstab_entity, "risk_crosstab_dow": q_risk_crosstab_dow,
    "risk_crosstab_daytype": q_risk_crosstab_daytype, "risk_by_daytype": q_risk_by_daytype,
    "risk_by_daytype_ranked": q_risk_by_daytype_ranked,
    "risk_holiday_summary": q_risk_holiday_summary, "risk_validation_summary": q_risk_validation_summary,
    "risk_checks": q_risk_checks,
}


# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------

def _bin_case(col: str, edges, labels, what: str = "label") -> str:
    parts = []
    for i in range(len(edges) - 1):
        val = f"'{labels[i]}'" if what == "label" else str(i)
        parts.append(f"WHEN {col} > {float(edges[i])} AND {col} <= {float(edges[i + 1])} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


def _describe_sql(group_expr: str, value: str, source: str, group_alias: str) -> str:
    v = f"CAST({value} AS DOUBLE)"
    return (f"SELECT {group_expr} AS {group_alias}, {r(f'AVG({v})', 'mean')}, "
            f"{r(f'quantile_cont({v}, 0.5)', 'median')}, {r(f'STDDEV_SAMP({v})', 'std')}, "
            f"COUNT({v}) AS count FROM {source} GROUP BY 1")


def _crosstab_sql(row_expr: str, source: str) -> str:
    tot = "COUNT(*)"
    return (f"SELECT {row_expr} AS row_key, "
            f"{r(f'COUNT(*) FILTER (WHERE risk_level = ' + chr(39) + 'Low Risk' + chr(39) + ') * 100.0 / ' + tot, 'low_risk')}, "
            f"{r(f'COUNT(*) FILTER (WHERE risk_level = ' + chr(39) + 'Medium Risk' + chr(39) + ') * 100.0 / ' + tot, 'medium_risk')}, "
            f"{r(f'COUNT(*) FILTER (WHERE risk_level = ' + chr(39) + 'High Risk' + chr(39) + ') * 100.0 / ' + tot, 'high_risk')} "
            f"FROM {source} WHERE risk_level IS NOT NULL GROUP BY 1")


def _per_entity_sql() -> str:
    return ("SELECT restaurant_id, COUNT(*) AS n, sqrt(AVG(power(total_orders - prediction, 2))) AS rmse, "
            "AVG(abs(total_orders - prediction)) AS mae, AVG(CAST(total_orders AS DOUBLE)) AS mean_actual, "
            "AVG(prediction) AS mean_predicted FROM predictions GROUP BY restaurant_id")


def _rule_counts_sql(source: str, rules: list[tuple[str, str]]) -> str:
    arr = ", ".join(f"CASE WHEN NOT COALESCE({ok}, false) THEN '{name}' END" for name, ok in rules)
    return f"""WITH t AS (SELECT list_filter([{arr}], lambda x: x IS NOT NULL) AS violations FROM {source})
SELECT rule, COUNT(*) AS n_violations FROM (SELECT unnest(violations) AS rule FROM t) GROUP BY rule
UNION ALL SELECT '_rows', COUNT(*) FROM t
UNION ALL SELECT '_valid', COUNT(*) FILTER (WHERE len(violations) = 0) FROM t"""


_MASTER_RULES = [
    ("restaurant_id_positive", "restaurant_id > 0"),
    ("name_length", "length(restaurant_name) BETWEEN 1 AND 256"),
    ("country_code_min", "country_code >= 1"),
    ("city_length", "length(trim(city)) BETWEEN 1 AND 128"),
    ("locality_length", "COALESCE(length(locality), 0) <= 256"),
    ("longitude_range", "longitude BETWEEN -180 AND 180"),
    ("latitude_range", "latitude BETWEEN -90 AND 90"),
    ("cuisine_nonempty", "len(list_filter(string_split(COALESCE(cuisines, ''), ','), lambda x: trim(x) <> '')) >= 1"),
    ("cost_nonnegative", "average_cost_for_two >= 0"),
    ("currency_length", "length(currency) BETWEEN 1 AND 16"),
    ("price_range_1_4", "price_range BETWEEN 1 AND 4"),
    ("rating_0_5", "aggregate_rating BETWEEN 0 AND 5"),
    ("votes_nonnegative", "votes >= 0"),
]
_ORDERS_RULES = [
    ("restaurant_id_positive", "restaurant_id > 0"),
    ("date_not_future", f"date <= DATE '{AS_OF_DATE}'"),
    ("orders_nonnegative", "total_orders >= 0"),
    ("revenue_nonnegative", "total_revenue >= 0"),
    ("discount_0_100", "COALESCE(avg_discount, 0.0) BETWEEN 0 AND 100"),
    ("cancellation_0_1", "cancellation_rate IS NULL OR cancellation_rate BETWEEN 0 AND 1"),
    ("delivery_nonnegative", "avg_delivery_time IS NULL OR avg_delivery_time >= 0"),
    ("zero_orders_zero_revenue", "total_orders <> 0 OR total_revenue = 0"),
]
_CONTEXT_RULES = [
    ("day_of_week_range", "day_of_week BETWEEN 0 AND 6"),
    ("day_of_week_matches_date", "day_of_week = isodow(date) - 1"),
    ("is_weekend_matches", "is_weekend = (day_of_week >= 5)"),
    ("month_range", "month BETWEEN 1 AND 12"),
    ("month_matches_date", "month = month(date)"),
    ("weather_label", "COALESCE(weather, 'Unknown') IN ('Clear', 'Cloudy', 'Rainy', 'Stormy', 'Snowy', 'Unknown')"),
    ("city_length", "length(trim(city)) BETWEEN 1 AND 128"),
]


def _records_sql(source: str, rules: list[tuple[str, str]], columns: dict[str, str | None], clean: dict[str, str]) -> str:
    """``columns``: each column, and its expression where it isn't the column; ``clean``: expressions for valid rows."""
    arr = ", ".join(f"CASE WHEN NOT COALESCE({ok}, false) THEN '{name}' END" for name, ok in rules)
    cols = ", ".join(f"CASE WHEN len(v) = 0 THEN {clean[c]} ELSE {c} END AS {c}" if c in clean else (e or c) for c, e in columns.items())
    return f"""SELECT {cols}, CASE WHEN len(v) = 0 THEN 'valid' ELSE 'quarantined' END AS status, array_to_string(v, ',') AS violations
FROM (SELECT *, list_filter([{arr}], lambda x: x IS NOT NULL) AS v FROM {source}) t"""


def _missing_cols_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table if table != 'master' else 'restaurants'}' AS dataset, '{c}' AS column, "
        f"COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null FROM {table}" for c in cols)


_MASTER_COLS = ["restaurant_id", "restaurant_name", "country_code", "city", "locality", "longitude", "latitude",
                "cuisines", "average_cost_for_two", "currency", "has_table_booking", "has_online_delivery",
                "is_delivering_now", "switch_to_order_menu", "price_range", "aggregate_rating", "votes"]
_DAILY_COLS = ["restaurant_id", "date", "total_orders", "total_revenue", "avg_discount", "promotion_flag",
               "cancellation_rate", "avg_delivery_time"]
_CONTEXT_COLS = ["date", "city", "day_of_week", "is_weekend", "is_holiday", "month", "weather", "event_flag"]


def _missing_total_sql(table: str, cols: list[str], name: str) -> str:
    s = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    return (f"SELECT '{name}' AS dataset, 'missing_values' AS \"check\", CAST(NULL AS VARCHAR) AS column, "
            f"CAST({s} AS DOUBLE) AS value FROM {table}")


def _basic_sql() -> str:
    return """basic AS (SELECT *, LAG(total_orders, 1) OVER w AS lag_1, LAG(total_orders, 7) OVER w AS lag_7,
  LAG(total_orders, 14) OVER w AS lag_14,
  CASE WHEN COUNT(total_orders) OVER w7 >= 7 THEN AVG(total_orders) OVER w7 END AS rolling_mean_7,
  CASE WHEN COUNT(total_orders) OVER w7 >= 7 THEN STDDEV_SAMP(total_orders) OVER w7 END AS rolling_std_7,
  CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(month(date) AS INT) AS month,
  CAST(isodow(date) - 1 >= 5 AS INT) AS is_weekend
  FROM daily_orders
  WINDOW w AS (PARTITION BY restaurant_id ORDER BY date),
         w7 AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


def _spearman_sql(col: str) -> str:
    return f"""SELECT '{col}' AS feature, COUNT(*) AS n,
  {r('corr(rx, ry)', 'rho')} FROM (
  SELECT rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT CAST({col} AS DOUBLE) AS x, CAST(total_orders AS DOUBLE) AS y FROM basic
        WHERE {col} IS NOT NULL AND total_orders IS NOT NULL)) HAVING COUNT(*) > 100"""


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["daily_trend"] = duck_with("SELECT date, CAST(SUM(total_orders) AS BIGINT) AS sum_total_orders FROM daily_orders GROUP BY date",
                                 "daily_orders")
    o["dow_pattern"] = duck_with(f"""SELECT d.day_of_week, d.day_name, {r('m.mean_total_orders', 'mean_total_orders')}
FROM (SELECT CAST(i AS INT) AS day_of_week,
             ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][i + 1] AS day_name
      FROM range(7) t(i)) d
LEFT JOIN (SELECT CAST(isodow(date) - 1 AS INT) AS day_of_week, AVG(total_orders) AS mean_total_orders
           FROM daily_orders GROUP BY 1) m USING (day_of_week)""", "daily_orders")
    o["weekend_pattern"] = duck_with(f"""SELECT CAST(isodow(date) - 1 >= 5 AS INT) AS is_weekend,
  {r('AVG(total_orders)', 'mean_total_orders')} FROM daily_orders GROUP BY 1""", "daily_orders")
    o["monthly_seasonality"] = duck_with("""SELECT CAST(month(date) AS INT) AS month, CAST(SUM(total_orders) AS BIGINT) AS sum_total_orders
FROM daily_orders GROUP BY 1""", "daily_orders")
    o["value_counts"] = duck_with(f"""SELECT city, COUNT(*) AS count,
  {r('COUNT(*) * 100.0 / SUM(COUNT(*)) OVER ()', 'share_pct')} FROM master WHERE city IS NOT NULL GROUP BY city""",
                                  "master")
    o["weather_impact"] = duck_with(_describe_sql("weather", "total_orders", _CTX_JOIN_SQL, "weather"),
                                    "daily_orders", "master", "external_context")
    o["promotion_impact"] = duck_with(_describe_sql("promotion_flag", "total_orders", "daily_orders",
                                                    "promotion_flag"), "daily_orders")
    o["flag_impact"] = duck_with(f"""SELECT flag, label, {r('AVG(total_orders)', 'mean_total_orders')} FROM (
  SELECT 'is_holiday' AS flag, CASE WHEN is_holiday THEN 'Holiday' WHEN NOT is_holiday THEN 'Non-Holiday' END AS label,
         total_orders FROM {_CTX_JOIN_SQL}
  UNION ALL
  SELECT 'event_flag', CASE WHEN event_flag THEN 'Event Day' WHEN NOT event_flag THEN 'No Event' END,
         total_orders FROM {_CTX_JOIN_SQL}) WHERE label IS NOT NULL GROUP BY flag, label""",
                                 "daily_orders", "master", "external_context")
    o["binned_mean_cancel"] = duck_with(f"""SELECT bin, bin_order, {r('AVG(total_orders)', 'mean_total_orders')} FROM (
  SELECT {_bin_case('cancellation_rate', A.CANCEL_BINS, A.CANCEL_LABELS)} AS bin,
         CAST({_bin_case('cancellation_rate', A.CANCEL_BINS, A.CANCEL_LABELS, 'ord')} AS INT) AS bin_order,
         total_orders FROM daily_orders) WHERE bin IS NOT NULL GROUP BY bin, bin_order""", "daily_orders")
    o["binned_mean_rating"] = duck_with(f"""SELECT bin, bin_order, {r('AVG(avg_total_orders)', 'mean_avg_total_orders')} FROM (
  SELECT {_bin_case('m.aggregate_rating', A.RATING_BINS, A.RATING_LABELS)} AS bin,
         CAST({_bin_case('m.aggregate_rating', A.RATING_BINS, A.RATING_LABELS, 'ord')} AS INT) AS bin_order,
         a.avg_total_orders
  FROM master m JOIN (SELECT restaurant_id, AVG(total_orders) AS avg_total_orders FROM daily_orders
                      GROUP BY restaurant_id) a USING (restaurant_id)) WHERE bin IS NOT NULL GROUP BY bin, bin_order""",
                                        "daily_orders", "master")
    o["box_stats"] = duck_with(f"""WITH b AS (
  SELECT {_bin_case('avg_discount', A.DISCOUNT_BINS, A.DISCOUNT_LABELS)} AS "group", CAST(total_orders AS DOUBLE) AS v
  FROM daily_orders),
q AS (SELECT "group", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3,
             COUNT(*) AS n FROM b WHERE "group" IS NOT NULL AND v IS NOT NULL GROUP BY "group")
SELECT q."group", {r('q.q1', 'q1')}, {r('q.median', 'median')}, {r('q.q3', 'q3')}, q.n,
  {r('MIN(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))', 'whisker_low')},
  {r('MAX(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))', 'whisker_high')}
FROM q JOIN b ON b."group" = q."group" WHERE b.v IS NOT NULL GROUP BY q."group", q.q1, q.median, q.q3, q.n""",
                               "daily_orders")
    o["flag_attr_means"] = duck_with(f"""WITH j AS (SELECT m.has_online_delivery, m.has_table_booking, a.avg_daily_orders
  FROM master m JOIN (SELECT restaurant_id, AVG(total_orders) AS avg_daily_orders FROM daily_orders
                      GROUP BY restaurant_id) a USING (restaurant_id))
SELECT attribute, value, {r('AVG(avg_daily_orders)', 'mean_avg_daily_orders')} FROM (
  SELECT 'has_online_delivery' AS attribute, has_online_delivery AS value, avg_daily_orders FROM j
  UNION ALL SELECT 'has_table_booking', has_table_booking, avg_daily_orders FROM j) GROUP BY attribute, value""",
                                     "daily_orders", "master")
    o["histogram"] = duck_with(f"""WITH rg AS (SELECT MIN(total_revenue) AS lo, MAX(total_revenue) AS hi FROM daily_orders),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 20.0 = 0 THEN 0
                  ELSE least(floor((total_revenue - lo) / ((hi - lo) / 20.0)), 19) END AS INT) AS bin, lo, hi
      FROM daily_orders, rg WHERE total_revenue IS NOT NULL)
SELECT bin, {r('lo + bin * ((hi - lo) / 20.0)', 'bin_start')}, {r('lo + (bin + 1) * ((hi - lo) / 20.0)', 'bin_end')},
  CAST(SUM(n) AS BIGINT) AS count
FROM (SELECT bin, lo, hi, 1 AS n FROM b UNION ALL SELECT CAST(range AS INT), lo, hi, 0 FROM range(20), rg)
GROUP BY bin, lo, hi""", "daily_orders")
    o["describe_numeric"] = duck_with(" UNION ALL ".join(
        f"SELECT '{c}' AS column, {r(f'COUNT({c})', 'count')}, {r(f'AVG({c})', 'mean')}, "
        f"{r(f'STDDEV_SAMP({c})', 'std')}, {r(f'MIN({c})', 'min')}, {r(f'quantile_cont({c}, 0.25)', 'p25')}, "
        f"{r(f'quantile_cont({c}, 0.5)', 'p50')}, {r(f'quantile_cont({c}, 0.75)', 'p75')}, {r(f'MAX({c})', 'max')} "
        f"FROM daily_orders" for c in DESCRIBE_COLUMNS), "daily_orders")
    o["describe_numeric_ranked"] = o["describe_numeric"]
    types = {"restaurant_id": "bigint", "date": "date", "total_orders": "bigint", "total_revenue": "double",
             "avg_discount": "double", "promotion_flag": "boolean", "cancellation_rate": "double",
             "avg_delivery_time": "double"}
    o["profile_columns"] = duck_with(" UNION ALL ".join(
        f"SELECT '{c}' AS column, '{t}' AS dtype, COUNT(DISTINCT {c}) AS n_distinct, "
        f"COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null, "
        f"{r(f'COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*)', 'null_pct')} FROM daily_orders"
        for c, t in types.items()), "daily_orders")
    o["dataset_summary"] = duck_with(f"""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT restaurant_id) AS n_restaurants,
  MIN(date) AS min_date, MAX(date) AS max_date, COUNT(DISTINCT date) AS n_dates,
  CAST(SUM(total_orders) AS BIGINT) AS total_orders, {r('AVG(total_orders)', 'mean_orders')},
  {r('SUM(CAST(total_revenue AS DECIMAL(18,2)))', 'total_revenue')}, {r('AVG(CAST(promotion_flag AS INT))', 'promo_rate')},
  {r('AVG(cancellation_rate)', 'mean_cancellation_rate')} FROM daily_orders""", "daily_orders")
    o["entity_metric_summary"] = duck_with(f"""SELECT COUNT(rmse) AS count, {r('AVG(rmse)', 'mean')},
  {r('quantile_cont(rmse, 0.5)', 'median')}, {r('STDDEV_SAMP(rmse)', 'std')} FROM ({_per_entity_sql()})""",
                                           "predictions")
    o["top_bottom_entities"] = duck_with("""WITH t AS (SELECT restaurant_id, CAST(SUM(total_orders) AS BIGINT) AS sum_total_orders
  FROM daily_orders GROUP BY restaurant_id)
(SELECT *, 'top' AS category FROM t ORDER BY sum_total_orders DESC NULLS LAST, restaurant_id LIMIT 5)
UNION ALL
(SELECT *, 'bottom' FROM t WHERE sum_total_orders IS NOT NULL ORDER BY sum_total_orders, restaurant_id LIMIT 5)""",
                                         "daily_orders")
    o["entity_best_worst"] = duck_with(f"""WITH p AS ({_per_entity_sql()}),
u AS ((SELECT *, 'best' AS category FROM p ORDER BY rmse, restaurant_id LIMIT 5)
      UNION ALL (SELECT *, 'worst' FROM p ORDER BY rmse DESC, restaurant_id LIMIT 5))
SELECT restaurant_id, n, {r('rmse', 'rmse')}, {r('mae', 'mae')}, {r('mean_actual', 'mean_actual')},
  {r('mean_predicted', 'mean_predicted')}, category FROM u""", "predictions")
    o["top_categories"] = duck_with("""SELECT city, COUNT(*) AS count FROM master WHERE city IS NOT NULL
GROUP BY city ORDER BY count DESC, city LIMIT 10""", "master")

    # D ops
    dq = [_missing_total_sql("master", _MASTER_COLS, "restaurants"),
          _missing_total_sql("daily_orders", _DAILY_COLS, "daily_orders"),
          _missing_total_sql("external_context", _CONTEXT_COLS, "external_context"),
          "SELECT 'restaurants', 'duplicate_ids', 'restaurant_id', CAST(COUNT(*) - COUNT(DISTINCT restaurant_id) "
          "- CASE WHEN COUNT(*) FILTER (WHERE restaurant_id IS NULL) > 0 THEN 1 ELSE 0 END AS DOUBLE) FROM master",
          "SELECT 'daily_orders', 'entities_with_missing_dates', 'date', CAST(COUNT(*) AS DOUBLE) FROM ("
          "SELECT restaurant_id FROM daily_orders GROUP BY restaurant_id "
          "HAVING COUNT(*) <> date_diff('day', MIN(date), MAX(date)) + 1)"]
    for c in ("total_orders", "total_revenue"):
        dq.append(f"SELECT 'daily_orders', 'iqr_outliers', '{c}', CAST(COUNT(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) "
                  f"OR {c} > q3 + 1.5 * (q3 - q1)) AS DOUBLE) FROM daily_orders, (SELECT quantile_cont({c}, 0.25) "
                  f"AS q1, quantile_cont({c}, 0.75) AS q3 FROM daily_orders)")
        dq.append(f"SELECT 'daily_orders', 'negative_values', '{c}', CAST(COUNT(*) FILTER (WHERE {c} < 0) AS DOUBLE) "
                  f"FROM daily_orders")
    o["quality_report"] = duck_with(" UNION ALL ".join(dq), "daily_orders", "master", "external_context")
    o["missing_values"] = duck_with(" UNION ALL ".join([
        _missing_cols_sql("master", _MASTER_COLS), _missing_cols_sql("daily_orders", _DAILY_COLS),
        _missing_cols_sql("external_context", _CONTEXT_COLS)]), "daily_orders", "master", "external_context")
    o["duplicate_ids"] = duck_with("""SELECT COUNT(*) - COUNT(DISTINCT restaurant_id)
  - CASE WHEN COUNT(*) FILTER (WHERE restaurant_id IS NULL) > 0 THEN 1 ELSE 0 END AS n_duplicates FROM master""",
                                   "master")
    o["date_continuity"] = duck_with("""SELECT restaurant_id, COUNT(*) AS n_rows,
  CAST(date_diff('day', MIN(date), MAX(date)) + 1 AS INT) AS n_days,
  CAST(date_diff('day', MIN(date), MAX(date)) + 1 - COUNT(*) AS BIGINT) AS n_missing
FROM daily_orders GROUP BY restaurant_id HAVING COUNT(*) <> date_diff('day', MIN(date), MAX(date)) + 1""",
                                     "daily_orders")
    o["missing_dates"] = duck_with("""SELECT s.restaurant_id, s.date FROM (
  SELECT restaurant_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT restaurant_id, MIN(date) AS d0, MAX(date) AS d1 FROM daily_orders GROUP BY restaurant_id)) s
ANTI JOIN daily_orders d ON d.restaurant_id = s.restaurant_id AND d.date = s.date""", "daily_orders")
    o["iqr_outliers"] = duck_with(" UNION ALL ".join(
        f"SELECT '{c}' AS column, {r('q1', 'q1')}, {r('q3', 'q3')}, {r('q1 - 1.5 * (q3 - q1)', 'lower')}, "
        f"{r('q3 + 1.5 * (q3 - q1)', 'upper')}, COUNT(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR "
        f"{c} > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM daily_orders, (SELECT quantile_cont({c}, 0.25) AS q1, "
        f"quantile_cont({c}, 0.75) AS q3 FROM daily_orders) GROUP BY q1, q3"
        for c in ("total_orders", "total_revenue")), "daily_orders")
    o["iqr_outliers_ranked"] = o["iqr_outliers"]
    o["negative_values"] = duck_with(" UNION ALL ".join(
        f"SELECT '{c}' AS column, COUNT(*) FILTER (WHERE {c} < 0) AS n_negative FROM daily_orders"
        for c in ("total_orders", "total_revenue", "avg_discount", "avg_delivery_time")), "daily_orders")
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    doubles = lambda schema: {f.name: r(f.name, f.name) if f.dataType.simpleString() == "double" else None for f in schema.fields}
    o["master_records"] = duck_with(_records_sql("master", _MASTER_RULES, doubles(schemas.MASTER), {
        "city": strip("city"), "locality": f"COALESCE({strip('locality')}, '')",
        "cuisines": f"array_to_string(list_filter(list_transform(string_split(cuisines, ','), lambda x: {strip('x')}), lambda x: x <> ''), ', ')",
        **{c: f"COALESCE({c}, 'No')" for c in ("has_table_booking", "has_online_delivery", "is_delivering_now", "switch_to_order_menu")}}), "master")
    as_of = [(n, e.replace(AS_OF_DATE, RECORDS_AS_OF)) for n, e in _ORDERS_RULES]
    columns = doubles(schemas.DAILY_ORDERS) | {"avg_discount": r("CASE WHEN len(v) = 0 THEN COALESCE(avg_discount, 0.0) ELSE avg_discount END", "avg_discount")}
    o["order_records"] = duck_with(_records_sql("daily_orders", as_of, columns, {"promotion_flag": "COALESCE(promotion_flag, FALSE)"}), "daily_orders")
    o["context_records"] = duck_with(_records_sql("external_context", _CONTEXT_RULES, doubles(schemas.EXTERNAL_CONTEXT), {
        "city": strip("city"), "weather": "COALESCE(weather, 'Unknown')", "is_holiday": "COALESCE(is_holiday, FALSE)", "event_flag": "COALESCE(event_flag, FALSE)"}), "master", "daily_orders", "external_context")
    o["validate_master"] = duck_with(_rule_counts_sql("master", _MASTER_RULES), "master")
    o["validate_orders"] = duck_with(_rule_counts_sql("daily_orders", _ORDERS_RULES), "daily_orders")
    o["validate_context"] = duck_with(_rule_counts_sql("external_context", _CONTEXT_RULES), "external_context")
    nulls = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in _DAILY_COLS)
    o["dataset_checks"] = duck_with(f"""WITH s AS (SELECT {nulls} AS n_null,
  COUNT(*) FILTER (WHERE total_orders < 0) AS neg_orders, COUNT(*) FILTER (WHERE total_revenue < 0) AS neg_revenue,
  COUNT(*) FILTER (WHERE NOT avg_discount BETWEEN 0 AND 100) AS bad_discount,
  COUNT(*) FILTER (WHERE NOT cancellation_rate BETWEEN 0 AND 1) AS bad_cancel,
  COUNT(*) FILTER (WHERE avg_delivery_time < 0) AS neg_delivery,
  COUNT(*) FILTER (WHERE total_orders = 0 AND total_revenue <> 0) AS zero_orders_revenue FROM daily_orders),
a AS (SELECT COUNT(*) AS n_absent FROM master m ANTI JOIN (SELECT DISTINCT restaurant_id FROM daily_orders) d
      ON d.restaurant_id = m.restaurant_id)
SELECT * FROM (VALUES ('expected_columns', true, CAST(0 AS BIGINT))) v("check", passed, n_failing)
UNION ALL SELECT 'no_nulls', n_null = 0, n_null FROM s
UNION ALL SELECT 'orders_nonnegative', neg_orders = 0, neg_orders FROM s
UNION ALL SELECT 'revenue_nonnegative', neg_revenue = 0, neg_revenue FROM s
UNION ALL SELECT 'discount_0_100', bad_discount = 0, bad_discount FROM s
UNION ALL SELECT 'cancellation_0_1', bad_cancel = 0, bad_cancel FROM s
UNION ALL SELECT 'delivery_nonnegative', neg_delivery = 0, neg_delivery FROM s
UNION ALL SELECT 'zero_orders_zero_revenue', zero_orders_revenue = 0, zero_orders_revenue FROM s
UNION ALL SELECT 'all_entities_present', n_absent = 0, n_absent FROM a""", "daily_orders", "master")
    o["pattern_lift"] = duck_with(f"""WITH j AS (SELECT d.*, h.d IS NOT NULL AS hol, isodow(d.date) - 1 >= 5 AS wk
  FROM daily_orders d LEFT JOIN (SELECT DISTINCT date AS d FROM external_context WHERE is_holiday) h ON h.d = d.date),
m AS (SELECT AVG(total_orders) FILTER (WHERE NOT wk AND NOT hol) AS weekday_mean,
  AVG(total_orders) FILTER (WHERE wk AND NOT hol) AS weekend_mean,
  AVG(total_orders) FILTER (WHERE hol) AS holiday_mean, AVG(total_orders) FILTER (WHERE NOT hol) AS non_holiday_mean,
  AVG(CAST(promotion_flag AS INT)) AS promo_rate FROM j)
SELECT {r('weekday_mean', 'weekday_mean')}, {r('weekend_mean', 'weekend_mean')}, {r('holiday_mean', 'holiday_mean')},
  {r('non_holiday_mean', 'non_holiday_mean')}, {r('promo_rate', 'promo_rate')},
  {r('(weekend_mean / weekday_mean - 1) * 100', 'weekend_lift_pct')},
  {r('(holiday_mean / weekday_mean - 1) * 100', 'holiday_lift_pct')},
  {r('(holiday_mean - non_holiday_mean) / non_holiday_mean * 100', 'holiday_vs_normal_pct')} FROM m""",
                                  "daily_orders", "external_context")
    o["geo_grid"] = duck_with("""SELECT CAST(floor(latitude / 10.0) AS BIGINT) AS lat_cell,
  CAST(floor(longitude / 10.0) AS BIGINT) AS lon_cell, COUNT(*) AS n_entities FROM master
WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2""", "master")

    # C ops
    pairs = [(a, b) for a in PEARSON_COLUMNS for b in PEARSON_COLUMNS]
    o["pearson_matrix"] = duck_with(" UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 'r')} "
        f"FROM daily_orders" for a, b in pairs), "daily_orders")
    o["target_correlation"] = duck_with(f"""WITH {_basic_sql()},
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(total_orders AS DOUBLE)) AS r FROM basic" for c in BASIC_NUMERIC)})
SELECT feature, {r('r', 'r')} FROM c ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 12""", "daily_orders")
    o["target_spearman"] = duck_with(f"WITH {_basic_sql()}\n" + " UNION ALL ".join(
        _spearman_sql(c) for c in ["lag_1", "lag_7", "avg_discount", "avg_delivery_time"]), "daily_orders")
    o["pearson_test"] = duck_with(f"""SELECT {r('corr(x, y)', 'r')}, COUNT(*) AS n,
  {r('corr(x, y) * sqrt((COUNT(*) - 2) / (1 - corr(x, y) * corr(x, y)))', 't_stat')}
FROM (SELECT CAST(avg_delivery_time AS DOUBLE) AS x, CAST(total_orders AS DOUBLE) AS y FROM daily_orders
      WHERE avg_delivery_time IS NOT NULL AND total_orders IS NOT NULL)""", "daily_orders")
    o["mann_whitney"] = _with_scored(f""", vc AS (SELECT risk_score AS v, COUNT(*) AS cnt,
  COUNT(*) FILTER (WHERE is_holiday = 1) AS cnt1 FROM scored_days WHERE risk_score IS NOT NULL GROUP BY risk_score),
rk AS (SELECT *, COALESCE(SUM(cnt) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + (cnt + 1) / 2.0 AS avg_rank FROM vc)
SELECT CAST(SUM(cnt1) AS BIGINT) AS n1, CAST(SUM(cnt) - SUM(cnt1) AS BIGINT) AS n2, {r('SUM(avg_rank * cnt1)', 'rank_sum_1')},
  {r('SUM(power(CAST(cnt AS DOUBLE), 3) - cnt)', 'tie_term')},
  {r('SUM(avg_rank * cnt1) - SUM(cnt1) * (SUM(cnt1) + 1) / 2.0', 'u1')} FROM rk""", days=True).replace(
        ")\n, vc AS", "),\nvc AS")
    o["simple_regression"] = duck_with(f"""SELECT {r('regr_slope(total_orders, avg_delivery_time)', 'slope')},
  {r('regr_intercept(total_orders, avg_delivery_time)', 'intercept')},
  {r('regr_r2(total_orders, avg_delivery_time)', 'r2')},
  CAST(regr_count(total_orders, avg_delivery_time) AS BIGINT) AS n FROM daily_orders""", "daily_orders")

    # splits
    o["time_split"] = duck_with("""SELECT restaurant_id, date,
  CASE WHEN row_number() OVER (ORDER BY date, restaurant_id) <= floor(COUNT(*) OVER () * 0.8) THEN 'train'
       ELSE 'test' END AS split FROM daily_orders""", "daily_orders")
    o["entity_split"] = duck_with("""SELECT restaurant_id, date,
  CASE WHEN row_number() OVER (ORDER BY restaurant_id, date) <= floor(COUNT(*) OVER () * 0.8) THEN 'train'
       ELSE 'test' END AS split FROM daily_orders""", "daily_orders")
    o["time_folds"] = duck_with("""WITH d AS (SELECT date, CAST(floor((row_number() OVER (ORDER BY date) - 1) * 6
  / COUNT(*) OVER ()) AS INT) AS b FROM (SELECT DISTINCT date FROM daily_orders))
SELECT CAST(f AS INT) AS fold, date, CASE WHEN b = f THEN 'validation' ELSE 'train' END AS role
FROM d, range(1, 6) t(f) WHERE b <= f""", "daily_orders")

    # E ops
    o["regression_metrics"] = duck_with(f"""SELECT COUNT(total_orders - prediction) AS n,
  {r('sqrt(AVG(power(total_orders - prediction, 2)))', 'rmse')}, {r('AVG(abs(total_orders - prediction))', 'mae')},
  {r('AVG(power(total_orders - prediction, 2))', 'mse')},
  {r('1 - SUM(power(total_orders - prediction, 2)) / (var_pop(CAST(total_orders AS DOUBLE)) * COUNT(total_orders))', 'r2')},
  {r('AVG(abs(total_orders - prediction) / CASE WHEN total_orders <> 0 THEN abs(total_orders) END)', 'mape')}
FROM predictions""", "predictions")
    o["pinball_loss"] = duck_with(" UNION ALL ".join(
        f"SELECT CAST({a} AS DOUBLE) AS alpha, {r(f'AVG(greatest({a} * (total_orders - {c}), ({a} - 1) * (total_orders - {c})))', 'pinball')}, "
        f"{r(f'AVG(abs(total_orders - {c}))', 'mae')} FROM predictions"
        for a, c in ((0.1, "lower_bound"), (0.5, "prediction"), (0.9, "upper_bound"))), "predictions")
    o["entity_performance"] = duck_with(f"""SELECT restaurant_id, n, {r('rmse', 'rmse')}, {r('mae', 'mae')},
  {r('mean_actual', 'mean_actual')}, {r('mean_predicted', 'mean_predicted')} FROM ({_per_entity_sql()})""",
                                        "predictions")
    o["interval_coverage"] = duck_with(f"""SELECT {r('AVG(CAST(total_orders >= lower_bound AND total_orders <= upper_bound AS INT))', 'coverage')},
  COUNT(*) AS n FROM predictions""", "predictions")
    o["eval_two_tables"] = duck_with(f"""WITH j AS (SELECT CAST(a.total_orders AS DOUBLE) AS y, p.prediction AS p
  FROM daily_orders a FULL JOIN predictions p ON a.restaurant_id = p.restaurant_id AND a.date = p.date)
SELECT COUNT(*) FILTER (WHERE y IS NOT NULL AND p IS NOT NULL) AS n_matched,
  COUNT(*) FILTER (WHERE p IS NULL) AS n_actual_only, COUNT(*) FILTER (WHERE y IS NULL) AS n_predicted_only,
  {r('sqrt(AVG(power(y - p, 2)))', 'rmse')}, {r('AVG(abs(y - p))', 'mae')} FROM j""",
                                     "daily_orders", "predictions")

    # R ops
    o["bounded_forecast"] = _with_scored(f"""SELECT restaurant_id, date, {r('prediction', 'prediction')},
  {r('lower_bound', 'lower_bound')}, {r('upper_bound', 'upper_bound')} FROM scored""")
    o["risk_scores"] = _with_scored(f"SELECT restaurant_id, date, {r('risk_score', 'risk_score')}, risk_level FROM scored")
    per_entity_risk = ("SELECT restaurant_id, AVG(risk_score) AS avg_risk, quantile_cont(risk_score, 0.5) AS med_risk, "
                       "STDDEV_SAMP(risk_score) AS risk_std, COUNT(risk_score) AS n_obs FROM scored GROUP BY restaurant_id")
    o["risk_by_entity"] = _with_scored(f"""SELECT restaurant_id, {r('avg_risk', 'avg_risk')}, {r('med_risk', 'med_risk')},
  {r('risk_std', 'risk_std')}, n_obs FROM ({per_entity_risk})""")
    o["riskiest_entities"] = _with_scored(f""", pe AS ({per_entity_risk}),
u AS ((SELECT *, 'riskiest' AS category FROM pe ORDER BY avg_risk DESC NULLS LAST, restaurant_id LIMIT 10)
  UNION ALL (SELECT *, 'safest' FROM pe WHERE avg_risk IS NOT NULL ORDER BY avg_risk, restaurant_id DESC LIMIT 10))
SELECT restaurant_id, {r('avg_risk', 'avg_risk')}, {r('med_risk', 'med_risk')}, {r('risk_std', 'risk_std')},
  n_obs, category FROM u""").replace(")\n, pe AS", "),\npe AS")
    o["risk_by_dow"] = _with_scored(f"""SELECT day_of_week,
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][day_of_week + 1] AS day_name,
  mean, median, std, count FROM ({_describe_sql('day_of_week', 'risk_score', 'scored_days', 'day_of_week')})""",
                                    days=True)
    o["risk_crosstab_entity"] = _with_scored(f""", top AS (SELECT restaurant_id FROM ({per_entity_risk})
  ORDER BY avg_risk DESC NULLS LAST, restaurant_id LIMIT 30)
{_crosstab_sql('restaurant_id', '(SELECT * FROM scored SEMI JOIN top USING (restaurant_id))')}""").replace(
        ")\n, top AS", "),\ntop AS")
    o["risk_crosstab_dow"] = _with_scored(_crosstab_sql("day_name", "scored_days"), days=True)
    o["risk_crosstab_daytype"] = _with_scored(_crosstab_sql("day_type", "scored_days"), days=True)
    o["risk_by_daytype"] = _with_scored(_describe_sql("day_type", "risk_score", "scored_days", "day_type"), days=True)
    o["risk_by_daytype_ranked"] = o["risk_by_daytype"]
    o["risk_holiday_summary"] = _with_scored(f"""SELECT day_type, COUNT(*) AS n, {r('AVG(risk_score)', 'mean_risk')},
  {r('quantile_cont(risk_score, 0.5)', 'median_risk')}, {r('STDDEV_SAMP(risk_score)', 'std_risk')},
  {r("AVG(CAST(risk_level = 'Low Risk' AS INT)) * 100", 'low_risk_pct')},
  {r("AVG(CAST(risk_level = 'Medium Risk' AS INT)) * 100", 'medium_risk_pct')},
  {r("AVG(CAST(risk_level = 'High Risk' AS INT)) * 100", 'high_risk_pct')}
FROM scored_days GROUP BY day_type""", days=True)
    vs = """SELECT risk_level, CASE risk_level WHEN 'Low Risk' THEN 0 WHEN 'Medium Risk' THEN 1 ELSE 2 END AS level_order,
  COUNT(*) AS count, round_even(AVG(risk_score), 4) AS mean_risk_score,
  round_even(AVG(abs_error), 4) AS mean_abs_error, round_even(quantile_cont(abs_error, 0.5), 4) AS median_abs_error,
  round_even(AVG(interval_width), 4) AS mean_interval_width, round_even(AVG(within_interval), 4) AS coverage,
  round_even(AVG(prediction), 4) AS mean_prediction, round_even(AVG(CAST(total_orders AS DOUBLE)), 4) AS mean_actual
FROM scored WHERE risk_level IS NOT NULL GROUP BY risk_level"""
    o["risk_validation_summary"] = _with_scored(
        "SELECT risk_level, CAST(level_order AS INT) AS level_order, count, "
        + ", ".join(r(c, c) for c in ["mean_risk_score", "mean_abs_error", "median_abs_error", "mean_interval_width",
                                      "coverage", "mean_prediction", "mean_actual"])
        + f" FROM ({vs}) WHERE mean_risk_score IS NOT NULL AND mean_abs_error IS NOT NULL"
          " AND median_abs_error IS NOT NULL AND mean_interval_width IS NOT NULL AND coverage IS NOT NULL"
          " AND mean_prediction IS NOT NULL AND mean_actual IS NOT NULL")
    o["risk_checks"] = _with_scored(f""", vs AS ({vs}),
lv AS (SELECT COUNT(*) AS n_levels,
  bool_and(mae_ok) AS mae_mono, bool_and(w_ok) AS w_mono FROM (
  SELECT COALESCE(mean_abs_error <= LEAD(mean_abs_error) OVER (ORDER BY level_order), true) AS mae_ok,
         COALESCE(mean_interval_width <= LEAD(mean_interval_width) OVER (ORDER BY level_order), true) AS w_ok
  FROM vs)),
g AS (SELECT corr(risk_score, abs_error) AS r,
  MAX(risk_score) FILTER (WHERE risk_level = 'Low Risk') AS low_max,
  MIN(risk_score) FILTER (WHERE risk_level = 'Medium Risk') AS med_min,
  MAX(risk_score) FILTER (WHERE risk_level = 'Medium Risk') AS med_max,
  MIN(risk_score) FILTER (WHERE risk_level = 'High Risk') AS high_min FROM scored)
SELECT 'mae_increases_with_risk' AS "check", CASE WHEN n_levels >= 2 THEN mae_mono END AS passed,
  CAST(n_levels AS DOUBLE) AS detail FROM lv
UNION ALL SELECT 'width_increases_with_risk', CASE WHEN n_levels >= 2 THEN w_mono END, CAST(n_levels AS DOUBLE) FROM lv
UNION ALL SELECT 'risk_error_correlation_positive', r > 0, {r('r')} FROM g
UNION ALL SELECT 'class_boundaries_hold', COALESCE(low_max, 0) < 0.2 AND COALESCE(med_min, 0) >= 0.2
  AND COALESCE(med_max, 0) < 0.5 AND COALESCE(high_min, 0) >= 0.5, {r('high_min')} FROM g""").replace(
        ")\n, vs AS", "),\nvs AS")
    return o

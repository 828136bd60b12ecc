"""Exploratory aggregations, top-k reports and summaries.

All are hash aggregates (partial per task, final per key) over the input;
shares and percentages divide by a total read from a 1-row aggregate, not
from an unpartitioned window.  Top-k reports use ``orderBy().limit(k)``
(TakeOrderedAndProject: per-task top-k, no global sort) -- the limit is
the feature there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import WEEKDAY_NAMES
from ..functions.scalar import right_closed_bin
from .ranks import add_group_quantiles, present, quantiles, quantiles_and_more

# Bins of the exploratory reports (right-closed, pandas.cut).
DISCOUNT_BINS = [-0.01, 0, 5, 10, 20, 100]
DISCOUNT_LABELS = ["0%", "0–5%", "5–10%", "10–20%", "20%+"]
CANCEL_BINS = [-0.01, 0.02, 0.05, 0.10, 1.0]
CANCEL_LABELS = ["<2%", "2-5%", "5-10%", "10%+"]
RATING_BINS = [i * 0.5 for i in range(11)]
RATING_LABELS = [f"({a:.1f}, {b:.1f}]" for a, b in zip(RATING_BINS[:-1], RATING_BINS[1:])]


def daily_trend(daily: DataFrame, target: str = "total_orders") -> DataFrame:
    """A2: total per date."""
    return daily.groupBy("date").agg(F.sum(target).alias(f"sum_{target}"))


def dow_pattern(daily: DataFrame, target: str = "total_orders") -> DataFrame:
    """A3: mean per weekday, Monday..Sunday, absent days kept as NULL."""
    days = daily.sparkSession.createDataFrame(
        [(i, n) for i, n in enumerate(WEEKDAY_NAMES)], "day_of_week int, day_name string")
    means = daily.groupBy(F.weekday("date").cast("int").alias("day_of_week")) \
                 .agg(F.avg(target).alias(f"mean_{target}"))
    # the 7-row day table is a fixed literal: broadcast is bounded
    return F.broadcast(days).join(means, "day_of_week", "left")


def weekend_pattern(daily: DataFrame, target: str = "total_orders") -> DataFrame:
    """A4: mean per weekend flag."""
    return daily.groupBy((F.weekday("date") >= 5).cast("int").alias("is_weekend")) \
                .agg(F.avg(target).alias(f"mean_{target}"))


def monthly_seasonality(daily: DataFrame, target: str = "total_orders") -> DataFrame:
    """A5: sum per month number (years pooled)."""
    return daily.groupBy(F.month("date").cast("int").alias("month")).agg(F.sum(target).alias(f"sum_{target}"))


def entity_totals(daily: DataFrame, target: str = "total_orders") -> DataFrame:
    """Total per entity."""
    return daily.groupBy("restaurant_id").agg(F.sum(target).alias(f"sum_{target}"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share (percent) of each non-null value."""
    base = df.where(F.col(col).isNotNull())
    total = base.select(F.count(F.lit(1))).scalar()
    return base.groupBy(col).agg(F.count(F.lit(1)).alias("count")) \
               .withColumn("share_pct", F.col("count") * 100.0 / total)


def describe_by(df: DataFrame, by: str, value: str, method: str = "exact") -> DataFrame:
    """Mean, median, sample std and count of ``value`` per group; NaN is missing.

    ``method``: ``exact`` (distributed exact median joined on the group) or ``approx``.
    """
    v = present(value)
    agg = df.groupBy(by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("count"))
    out = add_group_quantiles(agg, df, [by], value, [0.5], ["median"], method)
    return out.select(by, "mean", "median", "std", "count")


def weather_impact(daily: DataFrame, context: DataFrame, master: DataFrame) -> DataFrame:
    """A8 on the series inner-joined to its context."""
    cm = master.select("restaurant_id", "city").distinct()
    ctx = context.select(F.col("date").alias("_d"), F.col("city").alias("_c"), "weather")
    joined = daily.join(cm, "restaurant_id", "left") \
                  .join(ctx, (F.col("date") == F.col("_d")) & (F.col("city") == F.col("_c")), "inner")
    return describe_by(joined, "weather", "total_orders")


def promotion_impact(daily: DataFrame) -> DataFrame:
    return describe_by(daily, "promotion_flag", "total_orders")


def flag_impact(daily: DataFrame, context: DataFrame, master: DataFrame) -> DataFrame:
    """A10: mean target under Holiday / Non-Holiday / Event Day / No Event."""
    cm = master.select("restaurant_id", "city").distinct()
    ctx = context.select(F.col("date").alias("_d"), F.col("city").alias("_c"), "is_holiday", "event_flag")
    j = daily.join(cm, "restaurant_id", "left") \
             .join(ctx, (F.col("date") == F.col("_d")) & (F.col("city") == F.col("_c")), "inner")
    long = j.select("total_orders", F.expr(
        "stack(2, 'is_holiday', CASE WHEN is_holiday THEN 'Holiday' WHEN NOT is_holiday THEN 'Non-Holiday' END,"
        " 'event_flag', CASE WHEN event_flag THEN 'Event Day' WHEN NOT event_flag THEN 'No Event' END)"
        " AS (flag, label)"))
    return long.where(F.col("label").isNotNull()).groupBy("flag", "label") \
               .agg(F.avg("total_orders").alias("mean_total_orders"))


def binned_mean(df: DataFrame, col: str, edges, labels, target: str) -> DataFrame:
    """Mean target per right-closed bin; only bins present, NULL bin dropped."""
    label, ordinal = right_closed_bin(col, edges, labels)
    return df.select(label.alias("bin"), ordinal.alias("bin_order"), F.col(target)) \
             .where(F.col("bin").isNotNull()) \
             .groupBy("bin", "bin_order").agg(F.avg(target).alias(f"mean_{target}"))


def box_stats(df: DataFrame, group: str | Column, value: str, method: str = "exact") -> DataFrame:
    """Box-plot numbers per group (quartiles + whiskers, no fliers).

    Pass 1: quartiles per group (``exact`` or ``approx``).  Pass 2: the
    whiskers are the min/max of the values inside [q1 - 1.5 IQR, q3 + 1.5 IQR],
    a conditional aggregate after joining the per-group fences back (one row
    per group).
    """
    g = group if isinstance(group, Column) else F.col(group)
    base = df.select(g.alias("group"), present(value).alias("_v")).where(F.col("_v").isNotNull())
    q = add_group_quantiles(base.groupBy("group").agg(F.count(F.lit(1)).alias("n")), base, ["group"], "_v",
                            [0.25, 0.5, 0.75], ["q1", "median", "q3"], method)
    fenced = base.join(q.select("group", "q1", "q3"), "group")
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("_v") >= F.col("q1") - 1.5 * iqr) & (F.col("_v") <= F.col("q3") + 1.5 * iqr)
    wh = fenced.groupBy("group").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"))
    return q.join(wh, "group")


def flag_attr_means(master: DataFrame, daily: DataFrame,
                    flags: Sequence[str] = ("has_online_delivery", "has_table_booking")) -> DataFrame:
    """Mean of the entity's average daily orders per Yes/No attribute."""
    avg = daily.groupBy("restaurant_id").agg(F.avg("total_orders").alias("avg_daily_orders"))
    j = master.join(avg, "restaurant_id", "inner")
    stack = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in flags)
    long = j.select("avg_daily_orders", F.expr(f"stack({len(flags)}, {stack}) AS (attribute, value)"))
    return long.groupBy("attribute", "value").agg(F.avg("avg_daily_orders").alias("mean_avg_daily_orders"))


def crosstab_pct(df: DataFrame, row: str | Column, col: str, levels: Sequence[str]) -> DataFrame:
    """Row-percentage cross-tab with a fixed column list (missing -> 0).

    Explicit pivot values make it a single aggregation pass.
    """
    r = row if isinstance(row, Column) else F.col(row)
    piv = df.groupBy(r.alias("row_key")).pivot(col, list(levels)).count().na.fill(0, subset=list(levels))
    total = sum((F.col(f"`{lv}`") for lv in levels), F.lit(0))
    return piv.select("row_key", *[(F.col(f"`{lv}`") * 100.0 / total).alias(_safe(lv)) for lv in levels])


def _safe(label: str) -> str:
    return label.lower().replace(" ", "_")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max; last bin closed; empty bins count 0 (no values: no rows)."""
    v = present(col)
    rng = df.select(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    width = (rng["hi"] - rng["lo"]) / F.lit(float(bins))
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((v - rng["lo"]) / width), F.lit(bins - 1))).cast("int")
    counts = df.where(v.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).where(rng["lo"].isNotNull())
    return every.join(counts, "bin", "left").select(
        "bin", (rng["lo"] + F.col("bin") * width).alias("bin_start"),
        (rng["lo"] + (F.col("bin") + 1) * width).alias("bin_end"), F.coalesce("_n", F.lit(0)).alias("count"))


def describe_numeric(df: DataFrame, columns: Sequence[str], method: str = "exact") -> DataFrame:
    """Count, mean, std, min, 25/50/75 %, max per column (pandas ``describe``; NaN is missing).

    Moments and the quartiles' sketches come from one scan over all columns; the quartiles are then
    refined (``ranks.quantiles_and_more``), so no task ever holds all distinct values of a column.  Jobs start here.
    ``method="approx"`` uses ``percentile_approx`` instead.
    """
    moments = {}
    for c in columns:
        v = present(c)
        moments |= {(c, "count"): F.count(v).cast("double"), (c, "mean"): F.avg(v), (c, "std"): F.stddev_samp(v), (c, "min"): F.min(v), (c, "max"): F.max(v)}
    quartiles, m = quantiles_and_more(df, columns, [0.25, 0.5, 0.75], moments, method)
    rows = [(c, *[m[c, k] for k in ("count", "mean", "std", "min")], *quartiles[c], m[c, "max"]) for c in dict.fromkeys(columns)]
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{k} double" for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")))


def _distinct_key(name: str, kind: T.DataType) -> Column:
    """A value as text that is equal where the values are."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0).cast(kind)).cast("string")  # -0.0 equals 0.0
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return c.cast("string")


def profile_columns(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Distinct count, null count, null %, type per column.

    Exact distinct counts come from one long (column, value) table that the map tasks fold first, so a value that
    many rows share is shuffled once a task.  ``approx_distinct`` uses sketches in the one aggregate instead.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.struct(F.count_if(c.isNull()).alias("n_null"), (F.approx_count_distinct(c) if approx_distinct else F.lit(0).cast("long")).alias("n_sketch")).alias(f"c{i}"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"c{i}").alias("s")) for i, f in enumerate(fields)])
    out = df.agg(*aggs).select("_n", F.inline(each))
    n_distinct = F.col("s.n_sketch")
    if not approx_distinct:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), _distinct_key(f.name, f.dataType).alias("v")) for i, f in enumerate(fields)])
        values = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.lit(1).alias("one"))
        out = out.join(values.groupBy("i").agg(F.count(F.lit(1)).alias("_d")), "i", "left")
        n_distinct = F.coalesce("_d", F.lit(0))
    return out.select("column", "dtype", n_distinct.alias("n_distinct"), F.col("s.n_null").alias("n_null"), (F.col("s.n_null") * 100.0 / F.col("_n")).alias("null_pct"))


def _feature_groups() -> dict[str, str]:
    """Column -> group label, from the lists that the feature builders build their columns from."""
    from . import temporal as W

    # fixed values: the labels, and the names that no list of parameters gives
    calendar = ["day_of_week", "day_of_month", "day_of_year", "week", "month", "quarter", "year", "is_weekend",
                "is_month_start", "is_month_end", "week_of_month"]
    cycles = [f"{wave}_{part}" for wave in ("sin", "cos") for part in ("day_of_week", "month", "day_of_year")]
    stats = [(stat, n) for stat in W.ROLLING_STATS for n in W.ROLLING_WINDOWS]
    members = {
        "Calendar features": calendar + cycles,
        "External context": ["is_holiday", "event_flag", "weather_encoded"],
        "Order lag features": [f"orders_lag_{n}" for n in W.ORDER_LAGS],
        "Order rolling features": [f"orders_r{stat}_{n}" for stat, n in stats],
        "Revenue lag features": [f"revenue_lag_{n}" for n in W.REVENUE_LAGS],
        "Revenue rolling features": [f"revenue_rmean_{n}" for n in W.REVENUE_ROLLING_WINDOWS],
        "Trend features": ["orders_diff_1", "orders_diff_7", "revenue_diff_1", "orders_momentum_7", "orders_ewm_7"],
    }
    return {name: label for label, names in members.items() for name in names}


def feature_group(name: str) -> str:
    """Group label of a feature-table column; a column that no builder adds is an original one."""
    return _feature_groups().get(name, "Original columns")


def feature_profile(df: DataFrame) -> DataFrame:
    """A17 for the feature table: group, type, null count and null % per column.

    One aggregate of ``count_if(isNull)`` over all columns, unpivoted.
    """
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    stack = ", ".join(f"'{f.name}', '{feature_group(f.name)}', '{f.dataType.simpleString()}', `{f.name}`"
                      for f in df.schema.fields)
    return one.selectExpr("_n", f"stack({len(df.columns)}, {stack}) AS (column, feature_group, dtype, n_null)") \
              .select("column", "feature_group", "dtype", "n_null",
                      (F.col("n_null") * 100.0 / F.col("_n")).alias("null_pct"))


def dataset_summary(daily: DataFrame) -> DataFrame:
    """Global scalars of the series."""
    return daily.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("restaurant_id").alias("n_restaurants"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.count_distinct("date").alias("n_dates"),
        F.sum("total_orders").alias("total_orders"),
        F.avg("total_orders").alias("mean_orders"),
        # money as decimal: an exact sum, independent of summation order
        F.sum(F.col("total_revenue").cast("decimal(18,2)")).cast("double").alias("total_revenue"),
        F.avg(F.col("promotion_flag").cast("int")).alias("promo_rate"),
        F.avg("cancellation_rate").alias("mean_cancellation_rate"),
    )


def metric_summary(df: DataFrame, metric: str, method: str = "exact") -> DataFrame:
    """Count, mean, median, std of a metric across entities; NaN is missing."""
    v = present(metric)
    med = quantiles(df, metric, [0.5], method=method).select("q0").scalar()
    return df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), med.alias("median"),
                  F.stddev_samp(v).alias("std"))


# ---------------------------------------------------------------------------
# top-k reports
# ---------------------------------------------------------------------------

def top_bottom(df: DataFrame, value: str, k: int, key: str = "restaurant_id") -> DataFrame:
    """K largest and k smallest rows by ``value`` with a label."""
    known = df.where(F.col(value).isNotNull())
    top = known.orderBy(F.col(value).desc(), F.col(key)).limit(k).withColumn("category", F.lit("top"))
    bottom = known.orderBy(F.col(value).asc(), F.col(key)).limit(k) \
               .withColumn("category", F.lit("bottom"))
    return top.unionByName(bottom)


def top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values (ties by value)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")) \
             .orderBy(F.col("count").desc(), F.col(col)).limit(n)

"""Prediction intervals -> risk scores, classes and risk analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import WEEKDAY_NAMES
from ..functions.scalar import nan_safe_greatest, nan_safe_least
from .explore import crosstab_pct, describe_by
from .ranks import add_group_quantiles

# Class thresholds and labels of the risk engine.
LOW_MAX = 0.2
MEDIUM_MAX = 0.5
RISK_LEVELS = ["Low Risk", "Medium Risk", "High Risk"]


def bounded(point: str | Column, lower: str | Column, upper: str | Column) -> tuple[Column, Column]:
    """Force the bounds around the point: lower=min(lower, point), upper=max(upper, point)."""
    p = F.col(point) if isinstance(point, str) else point
    lo = F.col(lower) if isinstance(lower, str) else lower
    hi = F.col(upper) if isinstance(upper, str) else upper
    return nan_safe_least(lo, p), nan_safe_greatest(hi, p)


def risk_score(point: str = "prediction", lower: str = "lower_bound", upper: str = "upper_bound") -> Column:
    """R2: (upper - lower) / (point + 1); point = -1 gives NULL, not inf."""
    return F.try_divide(F.col(upper) - F.col(lower), F.col(point) + F.lit(1.0))


def risk_level(score: str | Column = "risk_score") -> Column:
    """< 0.2 Low, < 0.5 Medium, else High; NULL score -> NULL."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s < LOW_MAX, RISK_LEVELS[0]).when(s < MEDIUM_MAX, RISK_LEVELS[1])
            .when(s.isNotNull(), RISK_LEVELS[2]))


def level_order(level: str | Column = "risk_level") -> Column:
    lv = F.col(level) if isinstance(level, str) else level
    return F.when(lv == RISK_LEVELS[0], 0).when(lv == RISK_LEVELS[1], 1).when(lv == RISK_LEVELS[2], 2)


def score(pred: DataFrame) -> DataFrame:
    """R2 + R3 and the per-row error columns the analyses use."""
    y = F.col("total_orders").cast("double")
    return pred.select(
        "*",
        risk_score().alias("risk_score"),
        risk_level(risk_score()).alias("risk_level"),
        F.abs(y - F.col("prediction")).alias("abs_error"),
        (F.col("upper_bound") - F.col("lower_bound")).alias("interval_width"),
        ((y >= F.col("lower_bound")) & (y <= F.col("upper_bound"))).cast("int").alias("within_interval"),
    )


def with_day_info(scored: DataFrame, context: DataFrame, master: DataFrame) -> DataFrame:
    """Add is_holiday (via the entity's city), day name and day type."""
    cm = master.select("restaurant_id", "city").distinct()
    ctx = context.select(F.col("date").alias("_d"), F.col("city").alias("_c"),
                         F.col("is_holiday").alias("_h")).distinct()
    j = scored.join(cm, "restaurant_id", "left") \
              .join(ctx, (F.col("date") == F.col("_d")) & (F.col("city") == F.col("_c")), "left")
    return j.drop("_d", "_c", "city").withColumn("is_holiday", F.coalesce(F.col("_h").cast("int"), F.lit(0))) \
            .drop("_h") \
            .withColumn("day_name", F.date_format("date", "EEEE")) \
            .withColumn("day_of_week", F.weekday("date").cast("int")) \
            .withColumn("day_type", F.when(F.col("is_holiday") == 1, "Holiday").otherwise("Regular Day"))


def risk_by_entity(scored: DataFrame) -> DataFrame:
    """Mean / median / std / count of the risk score per entity."""
    return describe_by(scored, "restaurant_id", "risk_score").select(
        "restaurant_id", F.col("mean").alias("avg_risk"), F.col("median").alias("med_risk"),
        F.col("std").alias("risk_std"), F.col("count").alias("n_obs"))


def riskiest_entities(scored: DataFrame, k: int = 10) -> DataFrame:
    """K riskiest and k safest entities by average risk."""
    per = risk_by_entity(scored)
    top = per.orderBy(F.col("avg_risk").desc_nulls_last(), "restaurant_id").limit(k) \
             .withColumn("category", F.lit("riskiest"))
    bot = per.where(F.col("avg_risk").isNotNull()).orderBy(F.col("avg_risk").asc(), F.col("restaurant_id").desc()) \
             .limit(k).withColumn("category", F.lit("safest"))
    return top.unionByName(bot)


def risk_crosstab(scored: DataFrame, row: str) -> DataFrame:
    """A14 over risk levels: row percentages Low / Medium / High."""
    return crosstab_pct(scored.where(F.col("risk_level").isNotNull()), row, "risk_level", RISK_LEVELS)


def risk_by_dow(scored_days: DataFrame) -> DataFrame:
    """Risk statistics per weekday, Monday..Sunday."""
    d = describe_by(scored_days, "day_of_week", "risk_score")
    names = F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.col("day_of_week") + 1)
    return d.select("day_of_week", names.alias("day_name"), "mean", "median", "std", "count")


def risk_holiday_summary(scored_days: DataFrame, method: str = "exact") -> DataFrame:
    """N, mean, median, std and the share of each level per day type."""
    s = F.col("risk_score")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_risk"), F.stddev_samp(s).alias("std_risk"),
            *[(F.avg((F.col("risk_level") == lv).cast("int")) * 100).alias(
                lv.lower().replace(" ", "_") + "_pct") for lv in RISK_LEVELS]]
    return add_group_quantiles(scored_days.groupBy("day_type").agg(*aggs), scored_days, ["day_type"],
                               "risk_score", [0.5], ["median_risk"], method)


def validation_summary(scored: DataFrame, method: str = "exact") -> DataFrame:
    """Named metrics per risk level, rounded half-even to 4, rows with NULLs dropped."""
    src = scored.where(F.col("risk_level").isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("count"),
        F.avg("risk_score").alias("mean_risk_score"),
        F.avg("abs_error").alias("mean_abs_error"),
        F.avg("interval_width").alias("mean_interval_width"),
        F.avg("within_interval").alias("coverage"),
        F.avg("prediction").alias("mean_prediction"),
        F.avg(F.col("total_orders").cast("double")).alias("mean_actual"),
    ]
    g = add_group_quantiles(src.groupBy("risk_level").agg(*aggs), src, ["risk_level"], "abs_error", [0.5],
                            ["median_abs_error"], method)
    metric = [c for c in g.columns if c not in ("risk_level", "count")]
    out = g.select("risk_level", level_order("risk_level").alias("level_order"), "count",
                   *[F.bround(c, 4).alias(c) for c in metric])
    return out.na.drop()


def risk_checks(scored: DataFrame) -> DataFrame:
    """Monotone MAE and width over levels, positive risk-error r, class boundaries.

    Everything is computed from the 3-row validation summary and one global
    aggregate; the result is a (check, passed, detail) table.
    """
    vs = validation_summary(scored)
    lv = vs.agg(
        F.count(F.lit(1)).alias("n_levels"),
        F.sort_array(F.collect_list(F.struct("level_order", "mean_abs_error", "mean_interval_width")))
        .alias("levels"))
    mono = lambda field: F.forall(
        F.sequence(F.lit(1), F.greatest(F.size("levels") - 1, F.lit(1))),
        lambda i: (F.size("levels") < 2) | (F.element_at("levels", i)[field]
                                            <= F.element_at("levels", i + 1)[field]))
    g = scored.agg(
        F.corr("risk_score", "abs_error").alias("r"),
        F.max(F.when(F.col("risk_level") == RISK_LEVELS[0], F.col("risk_score"))).alias("low_max"),
        F.min(F.when(F.col("risk_level") == RISK_LEVELS[1], F.col("risk_score"))).alias("med_min"),
        F.max(F.when(F.col("risk_level") == RISK_LEVELS[1], F.col("risk_score"))).alias("med_max"),
        F.min(F.when(F.col("risk_level") == RISK_LEVELS[2], F.col("risk_score"))).alias("high_min"),
    )
    lvl = lv.select(F.struct("*")).scalar()
    j = g.withColumn("levels", lvl["levels"]).withColumn("n_levels", lvl["n_levels"])
    bounds_ok = (F.coalesce(F.col("low_max"), F.lit(0.0)) < LOW_MAX) \
        & (F.coalesce(F.col("med_min"), F.lit(0.0)) >= LOW_MAX) \
        & (F.coalesce(F.col("med_max"), F.lit(0.0)) < MEDIUM_MAX) \
        & (F.coalesce(F.col("high_min"), F.lit(0.0)) >= MEDIUM_MAX)
    j = j.select(
        "*",
        F.when(F.col("n_levels") >= 2, mono("mean_abs_error")).alias("mae_monotone"),
        F.when(F.col("n_levels") >= 2, mono("mean_interval_width")).alias("width_monotone"),
        bounds_ok.alias("bounds_ok"),
    )
    return j.select(F.expr(
        "stack(4,"
        " 'mae_increases_with_risk', mae_monotone, CAST(n_levels AS DOUBLE),"
        " 'width_increases_with_risk', width_monotone, CAST(n_levels AS DOUBLE),"
        " 'risk_error_correlation_positive', r > 0, r,"
        " 'class_boundaries_hold', bounds_ok, high_min"
        ") AS (check, passed, detail)"))

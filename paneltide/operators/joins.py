"""Equi joins of the series with its lookup tables.

Broadcast policy: a side is hinted for broadcast only when its size has a
proven bound (a 1-row aggregate, a fixed literal table, a list bounded by a
key predicate).  Every other join is left to Spark: with AQE on, a side
whose *materialised* shuffle output is below
``spark.sql.adaptive.autoBroadcastJoinThreshold`` is turned into a
broadcast at run time, and anything larger stays a sort-merge join -- a
size check with a fallback, decided on real sizes instead of estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weather label -> integer code; unknown or missing -> 5.
WEATHER_CODES = {"Clear": 0, "Cloudy": 1, "Rainy": 2, "Snowy": 3, "Stormy": 4, "Unknown": 5}
WEATHER_DEFAULT = 5


def city_map(master: DataFrame) -> DataFrame:
    """De-duplicated (restaurant_id, city) pairs, the lookup side of J1."""
    return master.select("restaurant_id", "city").distinct()


def join_city(df: DataFrame, master: DataFrame) -> DataFrame:
    """Left join of the series to its entity's city."""
    return df.join(city_map(master), "restaurant_id", "left")


def flag_to_int(col: str, dtype: T.DataType) -> Column:
    """True/"True" -> 1, False/"False"/NULL/anything else -> 0."""
    c = F.col(col)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0))
    if isinstance(dtype, T.StringType):
        return F.when(c == "True", 1).otherwise(0)
    if isinstance(dtype, T.NumericType):
        return F.when(c == 1, 1).otherwise(0)
    return F.lit(0)


def weather_code(col: str | Column = "weather") -> Column:
    """weather label -> code via a literal map; unknown/NULL -> 5."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[F.lit(x) for kv in WEATHER_CODES.items() for x in kv])
    return F.coalesce(m[c], F.lit(WEATHER_DEFAULT)).cast("int")


def merge_context(df: DataFrame, context: DataFrame, master: DataFrame,
                  null_keys_match: bool = False) -> DataFrame:
    """J1 + J2: add is_holiday, event_flag, weather_encoded from the context.

    The context is pruned to the join keys and the three columns before the
    join.  ``null_keys_match`` reproduces pandas, which pairs NaN keys.
    """
    wanted = [c for c in ("is_holiday", "event_flag", "weather") if c in context.columns]
    # Renamed keys: the context may be derived from the same lineage as the
    # series (its dates), so column references must not be ambiguous.
    ctx = context.select(F.col("date").alias("_ctx_date"), F.col("city").alias("_ctx_city"), *wanted)
    with_city = join_city(df, master)
    same_city = (F.col("city").eqNullSafe(F.col("_ctx_city")) if null_keys_match
                 else F.col("city") == F.col("_ctx_city"))
    cond = (F.col("date") == F.col("_ctx_date")) & same_city
    joined = with_city.join(ctx, cond, "left")
    types = {f.name: f.dataType for f in context.schema.fields}
    extra = []
    for c in ("is_holiday", "event_flag"):
        if c in wanted:
            extra.append(flag_to_int(c, types[c]).alias(c))
    if "weather" in wanted:
        extra.append(weather_code("weather").alias("weather_encoded"))
    base = [c for c in df.columns]
    return joined.select(*base, *extra)


def join_entity_avg(master: DataFrame, daily: DataFrame, target: str = "total_orders") -> DataFrame:
    """Entity master inner-joined with the entity's mean daily target."""
    avg = daily.groupBy("restaurant_id").agg(F.avg(target).alias(f"avg_{target}"))
    return master.join(avg, "restaurant_id", "inner")


def dense_spine(keys: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """One row per key and calendar day in [start, end].

    ``start``/``end`` may be per-row columns or scalar sub-queries.  Each key
    row generates its own days (a Generate, not a join), so the spine is
    spread over the partitions of ``keys``.
    """
    return keys.select(key, F.explode(F.sequence(start, end)).alias("date"))


def entity_spine(daily: DataFrame, entity: str = "restaurant_id") -> DataFrame:
    """Dense (entity, date) spine over each entity's own [first, last] day."""
    bounds = daily.groupBy(entity).agg(F.min("date").alias("_d0"), F.max("date").alias("_d1"))
    return bounds.select(entity, F.explode(F.sequence("_d0", "_d1")).alias("date"))


def densify(daily: DataFrame, entity: str = "restaurant_id") -> DataFrame:
    """Calendar-complete series: every day in each entity's [first, last]
    range, absent days as rows of NULLs (row lags then become calendar lags)."""
    return entity_spine(daily, entity).join(daily, [entity, "date"], "left")


def city_date_spine(daily: DataFrame, context: DataFrame) -> DataFrame:
    """Dense city x day spine over the global date range of the series."""
    rng = daily.select(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    cities = context.select("city").where(F.col("city").isNotNull()).distinct()
    return dense_spine(cities, "city", rng["lo"], rng["hi"])


def eval_two_tables(actual: DataFrame, predicted: DataFrame, target: str = "total_orders",
                    pred_col: str = "prediction") -> DataFrame:
    """Key-aligned truth / prediction tables -> metrics and unmatched counts."""
    a = actual.select("restaurant_id", "date", F.col(target).cast("double").alias("_y"))
    p = predicted.select("restaurant_id", "date", F.col(pred_col).cast("double").alias("_p"))
    j = a.join(p, ["restaurant_id", "date"], "full")
    both = F.col("_y").isNotNull() & F.col("_p").isNotNull()
    err = F.when(both, F.col("_y") - F.col("_p"))
    return j.agg(
        F.count_if(both).alias("n_matched"),
        F.count_if(F.col("_p").isNull()).alias("n_actual_only"),
        F.count_if(F.col("_y").isNull()).alias("n_predicted_only"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
    )


def flag_from_dates(df: DataFrame, dates: DataFrame, flag: str, date_col: str = "date",
                    label_col: str | None = None) -> DataFrame:
    """1/0 flag (and optional label) from a date list, e.g. holidays.

    The date list is de-duplicated first so the left join cannot fan out;
    AQE broadcasts it when it is small (a calendar-bounded list usually is).
    """
    keep = [F.col(date_col).alias("_fd")] + ([F.col(label_col).alias(label_col)] if label_col else [])
    d = dates.select(*keep).dropDuplicates(["_fd"])
    out = df.join(d, F.col(date_col) == F.col("_fd"), "left")
    return out.withColumn(flag, F.col("_fd").isNotNull().cast("int")).drop("_fd")


def dates_from_ranges(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Union of inclusive date ranges -> distinct dates (explode + distinct)."""
    return ranges.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("date")).distinct()

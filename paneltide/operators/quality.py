"""Data-quality checks (D1-D10) as table-in / table-out operators.

Checks return DataFrames; the report (D1) is their union in one long
``(dataset, check, column, value)`` table.  Record rules (D6) tag each
row with the list of rules it breaks, so valid rows and the quarantine
are two filters of one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import entity_spine
from .ranks import present, quantile_values

# Allowed weather labels of the context.
WEATHER_LABELS = ["Clear", "Cloudy", "Rainy", "Stormy", "Snowy", "Unknown"]


def missing_by_column(df: DataFrame, dataset: str) -> DataFrame:
    """Null count per column (one aggregate, unpivoted)."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.selectExpr(f"'{dataset}' AS dataset", f"stack({len(df.columns)}, {stack}) AS (column, n_null)")


def missing_total(df: DataFrame, dataset: str) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])
    return df.agg(total.alias("n_missing")).select(F.lit(dataset).alias("dataset"), "n_missing")


def duplicate_ids(df: DataFrame, id_col: str = "restaurant_id") -> DataFrame:
    """D3: rows beyond the first per id (a second NULL id counts as a duplicate)."""
    c = F.col(id_col)
    return df.agg(
        (F.count(F.lit(1)) - F.count_distinct(c)
         - F.when(F.count_if(c.isNull()) > 0, 1).otherwise(0)).alias("n_duplicates"))


def date_continuity(daily: DataFrame, entity: str = "restaurant_id", date: str = "date") -> DataFrame:
    """Per entity, rows vs days in [first, last]; only entities with gaps."""
    g = daily.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.datediff(F.max(date), F.min(date)) + 1).alias("n_days"))
    return g.where(F.col("n_rows") != F.col("n_days")) \
            .withColumn("n_missing", F.col("n_days") - F.col("n_rows"))


def missing_dates(daily: DataFrame, entity: str = "restaurant_id") -> DataFrame:
    """The (entity, date) pairs absent inside each entity's range (J6 + anti join)."""
    return entity_spine(daily, entity).join(daily.select(entity, "date"), [entity, "date"], "left_anti")


def iqr_fences(df: DataFrame, columns: Sequence[str], method: str = "exact") -> dict[str, tuple[float, float, float, float] | None]:
    """(q1, q3, lower fence, upper fence) of each column; None for a column without values (jobs start here)."""
    out: dict = {}
    for c, (q1, q3) in quantile_values(df, columns, [0.25, 0.75], method).items():
        out[c] = None if q1 is None else (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def _outside(c: str, fence: tuple | None) -> Column:
    if fence is None:
        return F.lit(False)
    return (present(c) < F.lit(fence[2])) | (present(c) > F.lit(fence[3]))


def iqr_outliers(df: DataFrame, columns: Sequence[str], method: str = "exact") -> DataFrame:
    """X < q1 - 1.5 IQR or x > q3 + 1.5 IQR, per column; NaN is missing.

    Quartiles are exact (pandas' interpolation); ``method="approx"`` uses ``percentile_approx``.
    The second pass is one conditional count per column with the fences as numbers.
    """
    fences = iqr_fences(df, columns, method)
    aggs = []
    for c in columns:
        q1, q3, lo, hi = (F.lit(v).cast("double") for v in (fences[c] or (None,) * 4))
        aggs.append(F.struct(q1.alias("q1"), q3.alias("q3"), lo.alias("lower"), hi.alias("upper"),
                             F.count_if(_outside(c, fences[c])).alias("n_outliers")).alias(c))
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {stack}) AS (column, s)").select("column", "s.*")


def negative_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count of negative values per column."""
    one = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {stack}) AS (column, n_negative)")


def _n_missing(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])


def quality_report(master: DataFrame, daily: DataFrame, context: DataFrame, id_col: str = "restaurant_id",
                   targets: Sequence[str] = ("total_orders", "total_revenue")) -> DataFrame:
    """Every check of the data-quality report as rows of one table.

    One aggregate per table holds all its counts; only the entities' continuity is another one.
    """
    def rows(dataset: str, df: DataFrame, checks: list[tuple[str, str | None, Column]]) -> DataFrame:
        one = df.agg(*[v.cast("double").alias(f"v{i}") for i, (_, _, v) in enumerate(checks)])
        each = F.array(*[F.struct(F.lit(dataset).alias("dataset"), F.lit(check).alias("check"), F.lit(c).cast("string").alias("column"), F.col(f"v{i}").alias("value"))
                         for i, (check, c, _) in enumerate(checks)])
        return one.select(F.inline(each))

    fences = iqr_fences(daily, targets) if targets else {}
    duplicates = F.count(F.lit(1)) - F.count_distinct(F.col(id_col)) - F.when(F.count_if(F.col(id_col).isNull()) > 0, 1).otherwise(0)
    out = [
        rows("restaurants", master, [("missing_values", None, _n_missing(master)), ("duplicate_ids", id_col, duplicates)]),
        rows("daily_orders", daily, [("missing_values", None, _n_missing(daily)),
                                     *[("iqr_outliers", c, F.count_if(_outside(c, fences[c]))) for c in targets],
                                     *[("negative_values", c, F.count_if(F.col(c) < 0)) for c in targets]]),
        rows("external_context", context, [("missing_values", None, _n_missing(context))]),
        rows("daily_orders", date_continuity(daily), [("entities_with_missing_dates", "date", F.count(F.lit(1)))]),
    ]
    return reduce(DataFrame.unionByName, out)


# ---------------------------------------------------------------------------
# Record rules
# ---------------------------------------------------------------------------

def _rule(name: str, ok: Column) -> Column:
    """NULL counts as a pass only where the rule says the field is optional."""
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))


def _tag(df: DataFrame, rules: list[Column]) -> DataFrame:
    arr = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return df.withColumn("violations", arr)


def master_rules() -> list[Column]:
    c = F.col
    return [
        _rule("restaurant_id_positive", c("restaurant_id") > 0),
        _rule("name_length", F.length("restaurant_name").between(1, 256)),
        _rule("country_code_min", c("country_code") >= 1),
        _rule("city_length", F.length(F.trim(c("city"))).between(1, 128)),
        _rule("locality_length", F.coalesce(F.length("locality"), F.lit(0)) <= 256),
        _rule("longitude_range", c("longitude").between(-180, 180)),
        _rule("latitude_range", c("latitude").between(-90, 90)),
        _rule("cuisine_nonempty", F.size(F.filter(F.split(F.coalesce(c("cuisines"), F.lit("")), ","),
                                                  lambda x: F.trim(x) != "")) >= 1),
        _rule("cost_nonnegative", c("average_cost_for_two") >= 0),
        _rule("currency_length", F.length("currency").between(1, 16)),
        _rule("price_range_1_4", c("price_range").between(1, 4)),
        _rule("rating_0_5", c("aggregate_rating").between(0, 5)),
        _rule("votes_nonnegative", c("votes") >= 0),
    ]


def orders_rules(as_of_date: str) -> list[Column]:
    c = F.col
    return [
        _rule("restaurant_id_positive", c("restaurant_id") > 0),
        _rule("date_not_future", c("date") <= F.lit(as_of_date).cast("date")),
        _rule("orders_nonnegative", c("total_orders") >= 0),
        _rule("revenue_nonnegative", c("total_revenue") >= 0),
        _rule("discount_0_100", F.coalesce(c("avg_discount"), F.lit(0.0)).between(0, 100)),
        _rule("cancellation_0_1", c("cancellation_rate").isNull() | c("cancellation_rate").between(0, 1)),
        _rule("delivery_nonnegative", c("avg_delivery_time").isNull() | (c("avg_delivery_time") >= 0)),
        _rule("zero_orders_zero_revenue", (c("total_orders") != 0) | (c("total_revenue") == 0)),
    ]


def context_rules() -> list[Column]:
    c = F.col
    return [
        _rule("day_of_week_range", c("day_of_week").between(0, 6)),
        _rule("day_of_week_matches_date", c("day_of_week") == F.weekday("date")),
        _rule("is_weekend_matches", c("is_weekend") == (c("day_of_week") >= 5)),
        _rule("month_range", c("month").between(1, 12)),
        _rule("month_matches_date", c("month") == F.month("date")),
        _rule("weather_label", F.coalesce(c("weather"), F.lit("Unknown")).isin(WEATHER_LABELS)),
        _rule("city_length", F.length(F.trim(c("city"))).between(1, 128)),
    ]


def validate(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Rows with a ``violations`` array (empty = valid)."""
    return _tag(df, rules)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _or(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)).alias(name)


def clean_master(df: DataFrame) -> DataFrame:
    """city and locality stripped, cuisines stripped one by one (empty ones go), an absent locality "", absent flags "No"."""
    cuisines = F.array_join(F.filter(F.transform(F.split("cuisines", ","), _stripped), lambda x: x != ""), ", ")
    new = {"city": _stripped(F.col("city")), "locality": F.coalesce(_stripped(F.col("locality")), F.lit("")), "cuisines": cuisines}
    new |= {c: _or(c, "No") for c in ("has_table_booking", "has_online_delivery", "is_delivering_now", "switch_to_order_menu")}
    return df.withColumns({c: v for c, v in new.items() if c in df.columns})


def clean_orders(df: DataFrame) -> DataFrame:
    """an absent discount is 0, an absent promotion flag false."""
    return df.withColumns({"avg_discount": _or("avg_discount", 0.0), "promotion_flag": _or("promotion_flag", False)})


def clean_context(df: DataFrame) -> DataFrame:
    """city stripped, an absent weather is Unknown, absent holiday and event flags are false."""
    return df.withColumns({"city": _stripped(F.col("city")), "weather": _or("weather", "Unknown"), "is_holiday": _or("is_holiday", False), "event_flag": _or("event_flag", False)})


def records(df: DataFrame, rules: list[Column], clean) -> DataFrame:
    """Every row with ``status``: "valid" ones cleaned by ``clean``, "quarantined" ones as they came, with the broken rules in ``violations``."""
    valid, bad = split_valid(validate(df, rules))
    none = F.array().cast("array<string>")
    return clean(valid).withColumns({"status": F.lit("valid"), "violations": none}).unionByName(bad.withColumn("status", F.lit("quarantined")))


def split_valid(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) of a tagged frame."""
    return (tagged.where(F.size("violations") == 0).drop("violations"),
            tagged.where(F.size("violations") > 0))


def rule_counts(tagged: DataFrame) -> DataFrame:
    """Per-rule violation counts plus the total of checked and valid rows."""
    per_rule = tagged.select(F.explode("violations").alias("rule")).groupBy("rule") \
                     .agg(F.count(F.lit(1)).alias("n_violations"))
    totals = tagged.agg(F.count(F.lit(1)).alias("n_rows"),
                        F.count_if(F.size("violations") == 0).alias("n_valid"))
    summary = totals.select(F.expr("stack(2, '_rows', n_rows, '_valid', n_valid) AS (rule, n_violations)"))
    return per_rule.unionByName(summary)


# ---------------------------------------------------------------------------
# D8-D10
# ---------------------------------------------------------------------------

EXPECTED_DAILY_COLUMNS = ["restaurant_id", "date", "total_orders", "total_revenue", "avg_discount",
                          "promotion_flag", "cancellation_rate", "avg_delivery_time"]


def dataset_checks(daily: DataFrame, master: DataFrame) -> DataFrame:
    """The generator's assertions as a (check, passed, detail) table."""
    c = F.col
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(x).isNull()) for x in daily.columns])
    stats = daily.agg(
        nulls.alias("n_null"),
        F.count_if(c("total_orders") < 0).alias("neg_orders"),
        F.count_if(c("total_revenue") < 0).alias("neg_revenue"),
        F.count_if(~c("avg_discount").between(0, 100)).alias("bad_discount"),
        F.count_if(~c("cancellation_rate").between(0, 1)).alias("bad_cancel"),
        F.count_if(c("avg_delivery_time") < 0).alias("neg_delivery"),
        F.count_if((c("total_orders") == 0) & (c("total_revenue") != 0)).alias("zero_orders_revenue"),
        F.count_distinct("restaurant_id").alias("n_entities"),
    )
    n_absent = master.select("restaurant_id").join(daily.select("restaurant_id").distinct(),
                                                   "restaurant_id", "left_anti") \
                     .select(F.count(F.lit(1))).scalar()
    j = stats.withColumn("n_absent", n_absent)
    return j.select(F.expr(
        "stack(9,"
        " 'expected_columns', " + ("true" if list(daily.columns) == EXPECTED_DAILY_COLUMNS else "false") + ", CAST(0 AS BIGINT),"
        " 'no_nulls', n_null = 0, n_null,"
        " 'orders_nonnegative', neg_orders = 0, neg_orders,"
        " 'revenue_nonnegative', neg_revenue = 0, neg_revenue,"
        " 'discount_0_100', bad_discount = 0, bad_discount,"
        " 'cancellation_0_1', bad_cancel = 0, bad_cancel,"
        " 'delivery_nonnegative', neg_delivery = 0, neg_delivery,"
        " 'zero_orders_zero_revenue', zero_orders_revenue = 0, zero_orders_revenue,"
        " 'all_entities_present', n_absent = 0, n_absent"
        ") AS (check, passed, n_failing)"))


def pattern_lift(daily: DataFrame, context: DataFrame) -> DataFrame:
    """Weekday / weekend / holiday means, lifts in percent, promotion rate.

    Holidays are the context's holiday dates (a distinct date list, small
    and calendar-bounded: AQE broadcasts it).  Two definitions are given:
    weekday/weekend excluding holidays (current generator) and holiday vs
    all other days (older generator).
    """
    hol = context.where(F.col("is_holiday")).select(F.col("date").alias("_hd")).distinct()
    j = daily.join(hol, F.col("date") == F.col("_hd"), "left").withColumn("_h", F.col("_hd").isNotNull())
    wk = F.weekday("date") >= 5
    h = F.col("_h")
    t = F.col("total_orders").cast("double")
    one = j.agg(
        F.avg(F.when(~wk & ~h, t)).alias("weekday_mean"),
        F.avg(F.when(wk & ~h, t)).alias("weekend_mean"),
        F.avg(F.when(h, t)).alias("holiday_mean"),
        F.avg(F.when(~h, t)).alias("non_holiday_mean"),
        F.avg(F.col("promotion_flag").cast("int")).alias("promo_rate"),
    )
    return one.select(
        "*",
        ((F.col("weekend_mean") / F.col("weekday_mean") - 1) * 100).alias("weekend_lift_pct"),
        ((F.col("holiday_mean") / F.col("weekday_mean") - 1) * 100).alias("holiday_lift_pct"),
        ((F.col("holiday_mean") - F.col("non_holiday_mean")) / F.col("non_holiday_mean") * 100)
        .alias("holiday_vs_normal_pct"),
    )


def geo_grid(master: DataFrame, cell: float = 1.0) -> DataFrame:
    """Entity counts per lat/long grid cell."""
    return master.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).groupBy(
        F.floor(F.col("latitude") / cell).alias("lat_cell"),
        F.floor(F.col("longitude") / cell).alias("lon_cell"),
    ).agg(F.count(F.lit(1)).alias("n_entities"))


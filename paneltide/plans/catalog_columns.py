"""Registered projection / filter / fill queries (P ops) and file round trips (S ops)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalar as SC
from ..operators import columns as P
from ..operators import explore as A
from ..operators import static as ST
from ..sources import files as S
from ..sources.bindings import duck_with, load_inputs
from . import features as X
from .common import r, rounded

LAG_COLS = ["lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_std_7"]
DATE_FROM, DATE_TO = "1997-01-01", "1997-12-31"


def _raw_header(name: str) -> str:
    """The raw CSV header style: 'Restaurant ID', with a BOM on the first column."""
    return " " + name.replace("_", " ").title().replace(" Id", " ID") + " "


def q_normalise_columns(spark, sf):
    m = load_inputs(spark, sf).master
    raw = m.toDF(*[("\ufeff" if i == 0 else "") + _raw_header(c) for i, c in enumerate(m.columns)])
    return P.normalise_columns(raw)


def q_rename_project(spark, sf):
    d = load_inputs(spark, sf).daily_orders
    return P.rename(d, {"total_orders": "orders", "total_revenue": "revenue", "absent": "x"}) \
            .select("restaurant_id", "date", "orders", "revenue")


def q_static_select(spark, sf):
    return P.drop_if_present(load_inputs(spark, sf).master, ST.DROP_COLUMNS + ["switch_to_order_menu"])


def q_filter_date_range(spark, sf):
    return P.filter_date_range(load_inputs(spark, sf).daily_orders, DATE_FROM, DATE_TO)


def q_filter_flags(spark, sf):
    d = load_inputs(spark, sf).daily_orders
    return d.where(P.not_(F.col("promotion_flag")) & P.not_(F.weekday("date") >= 5) & (F.col("total_orders") > 1))


def q_semi_top_entities(spark, sf):
    d = load_inputs(spark, sf).daily_orders
    top = A.entity_totals(d).orderBy(F.col("sum_total_orders").desc(), "restaurant_id").limit(5)
    return P.semi_filter(d, top)


def q_drop_null_lags(spark, sf):
    return rounded(P.drop_nulls(X.basic_features(load_inputs(spark, sf).daily_orders), LAG_COLS))


def q_fill_constant(spark, sf):
    return rounded(P.fill_constant(X.basic_features(load_inputs(spark, sf).daily_orders), 0, LAG_COLS))


def q_median_fill(spark, sf):
    b = X.basic_features(load_inputs(spark, sf).daily_orders)
    return rounded(P.median_fill(b, LAG_COLS + ["avg_discount"]))


def q_seeded_sample(spark, sf):
    return rounded(P.seeded_sample(load_inputs(spark, sf).daily_orders, 500, ["restaurant_id", "date"], seed=42))


def q_scan_roundtrip(spark, sf):
    """Write the series as header CSV and read it back with the fixed schema."""
    d = load_inputs(spark, sf).daily_orders
    path = S.fresh_scratch(spark, "daily_orders_csv")
    S.write_csv(d, path)
    return S.read_csv(spark, path, schemas.DAILY_ORDERS)


def q_scan_by_name(spark, sf):
    """A raw file with a BOM, raw header names, another order of columns and one more column, read by name."""
    m = load_inputs(spark, sf).master
    names = list(reversed(m.columns))
    raw = m.select(*[F.col(c).alias(("\ufeff" if i == 0 else "") + _raw_header(c).strip()) for i, c in enumerate(names)], F.lit("x").alias("Extra Column"))
    path = S.fresh_scratch(spark, "master_csv")
    S.write_csv(raw, path)
    return S.read_csv(spark, path, schemas.MASTER)


def q_promotion_labels(spark, sf):
    """orders and revenue with the promotion flag as a label."""
    d = load_inputs(spark, sf).daily_orders
    return rounded(d.select("restaurant_id", "date", "total_orders", "total_revenue", SC.label_flag("promotion_flag", "Promotion", "No Promotion").alias("promo")))


def q_sink_roundtrip(spark, sf):
    """The month-partitioned Parquet sink read back (partition column included)."""
    d = load_inputs(spark, sf).daily_orders
    path = S.fresh_scratch(spark, "daily_orders_parquet")
    S.write_series(d, path)
    return spark.read.parquet(path)


def q_read_if_exists(spark, sf):
    """A written table read back, plus an absent path giving an empty frame of the schema."""
    d = load_inputs(spark, sf).daily_orders
    path = S.fresh_scratch(spark, "daily_orders_present")
    S.write_parquet(d, path)
    present = S.read_if_exists(spark, path, schemas.DAILY_ORDERS)
    absent = S.read_if_exists(spark, path + "-absent", schemas.DAILY_ORDERS)
    return present.unionByName(absent)


def q_quality_report_text(spark, sf):
    """The quality report written as text lines and read back."""
    from ..operators import quality as D
    i = load_inputs(spark, sf)
    path = S.fresh_scratch(spark, "quality_report_txt")
    S.write_report_text(D.quality_report(i.master, i.daily_orders, i.external_context), path)
    return spark.read.text(path)


# Holiday month-days and event ranges (month-day, inclusive) of the context.
HOLIDAYS = [(101, "New Year"), (126, "Republic Day"), (501, "Labour Day"), (815, "Independence Day"),
            (1002, "Gandhi Jayanti"), (1225, "Christmas"), (1231, "New Year's Eve")]
EVENT_RANGES = [(1224, 1231), (101, 102), (1003, 1012)]


def q_holiday_event_flags(spark, sf):
    """Holiday flag + name from a date list, event flag from date ranges.

    Holidays and event ranges are month-day rules expanded to real dates for
    every year present in the series (explode of per-year ranges, distinct).
    """
    from ..operators import joins as JN
    d = load_inputs(spark, sf).daily_orders.select("date").distinct()
    years = d.select(F.year("date").alias("y")).distinct()
    # the fixed rules are literal arrays exploded next to each year (a Generate, no join)
    hol = F.array(*[F.struct(F.lit(m).alias("mmdd"), F.lit(n).alias("holiday_name")) for m, n in HOLIDAYS])
    hol_dates = years.select("y", F.inline(hol)).select(
        F.make_date("y", (F.col("mmdd") / 100).cast("int"), F.col("mmdd") % 100).alias("date"), "holiday_name")
    rng = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EVENT_RANGES])
    ranges = years.select("y", F.inline(rng)).select(
        F.make_date("y", (F.col("a") / 100).cast("int"), F.col("a") % 100).alias("start"),
        F.make_date("y", (F.col("b") / 100).cast("int"), F.col("b") % 100).alias("end"))
    out = JN.flag_from_dates(d, hol_dates, "is_holiday", label_col="holiday_name")
    out = JN.flag_from_dates(out, JN.dates_from_ranges(ranges), "event_flag")
    return out.select("date", "is_holiday", "holiday_name", "event_flag")


QUERIES = {
    "read_if_exists": q_read_if_exists, "quality_report_text": q_quality_report_text,
    "holiday_event_flags": q_holiday_event_flags,
    "normalise_columns": q_normalise_columns, "rename_project": q_rename_project,
    "static_select": q_static_select, "filter_date_range": q_filter_date_range,
    "filter_flags": q_filter_flags, "semi_top_entities": q_semi_top_entities,
    "drop_null_lags": q_drop_null_lags, "fill_constant": q_fill_constant, "median_fill": q_median_fill,
    "seeded_sample": q_seeded_sample, "scan_roundtrip": q_scan_roundtrip,
    "scan_by_name": q_scan_by_name, "promotion_labels": q_promotion_labels, "sink_roundtrip": q_sink_roundtrip,
}


def _basic_sql(select: str) -> str:
    return f"""WITH basic AS (SELECT *, CAST(LAG(total_orders, 1) OVER w AS DOUBLE) AS lag_1,
  CAST(LAG(total_orders, 7) OVER w AS DOUBLE) AS lag_7, CAST(LAG(total_orders, 14) OVER w AS DOUBLE) AS lag_14,
  CASE WHEN COUNT(total_orders) OVER w7 >= 7 THEN AVG(total_orders) OVER w7 END AS rolling_mean_7,
  CASE WHEN COUNT(total_orders) OVER w7 >= 7 THEN STDDEV_SAMP(total_orders) OVER w7 END AS rolling_std_7,
  CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(weekofyear(date) AS INT) AS week,
  CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year,
  CAST(isodow(date) - 1 >= 5 AS INT) AS is_weekend
  FROM daily_orders
  WINDOW w AS (PARTITION BY restaurant_id ORDER BY date),
         w7 AS (PARTITION BY restaurant_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
{select}"""


_BASIC_OUT = ["restaurant_id", "date", "total_orders", "promotion_flag", "day_of_week", "week", "month", "year",
              "is_weekend"]
_BASIC_DBL = ["total_revenue", "avg_discount", "cancellation_rate", "avg_delivery_time"]


def _basic_select(lag_expr) -> str:
    cols = _BASIC_OUT + [r(c, c) for c in _BASIC_DBL] + [r(lag_expr(c), c) for c in LAG_COLS]
    return ", ".join(cols)


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["normalise_columns"] = duck_with("SELECT * FROM master", "master")
    o["seeded_sample"] = duck_with(f"""SELECT restaurant_id, date, total_orders, {r('total_revenue', 'total_revenue')},
  {r('avg_discount', 'avg_discount')}, promotion_flag, {r('cancellation_rate', 'cancellation_rate')},
  {r('avg_delivery_time', 'avg_delivery_time')}
FROM daily_orders ORDER BY md5(concat_ws('|', CAST(restaurant_id AS VARCHAR), CAST(date AS VARCHAR), '42')),
  restaurant_id, date LIMIT 500""", "daily_orders")
    o["rename_project"] = duck_with("SELECT restaurant_id, date, total_orders AS orders, total_revenue AS revenue "
                                    "FROM daily_orders", "daily_orders")
    o["static_select"] = duck_with("SELECT * EXCLUDE (restaurant_name, locality, currency, cuisines, "
                                   "switch_to_order_menu) FROM master", "master")
    o["filter_date_range"] = duck_with(f"SELECT * FROM daily_orders WHERE date BETWEEN DATE '{DATE_FROM}' "
                                       f"AND DATE '{DATE_TO}'", "daily_orders")
    o["filter_flags"] = duck_with("SELECT * FROM daily_orders WHERE NOT COALESCE(promotion_flag, false) "
                                  "AND NOT COALESCE(isodow(date) - 1 >= 5, false) AND total_orders > 1",
                                  "daily_orders")
    o["semi_top_entities"] = duck_with("""SELECT * FROM daily_orders SEMI JOIN (
  SELECT restaurant_id FROM daily_orders GROUP BY restaurant_id ORDER BY SUM(total_orders) DESC, restaurant_id
  LIMIT 5) t USING (restaurant_id)""", "daily_orders")
    nonnull = " AND ".join(f"{c} IS NOT NULL" for c in LAG_COLS)
    o["drop_null_lags"] = duck_with(_basic_sql(f"SELECT {_basic_select(lambda c: c)} FROM basic WHERE {nonnull}"),
                                    "daily_orders")
    o["fill_constant"] = duck_with(_basic_sql(f"SELECT {_basic_select(lambda c: f'COALESCE({c}, 0)')} FROM basic"),
                                   "daily_orders")
    med_cols = LAG_COLS + ["avg_discount"]
    meds = ", ".join(f"median({c}) AS m_{c}" for c in med_cols)
    cols = _BASIC_OUT + [r(c, c) for c in _BASIC_DBL if c != "avg_discount"] + \
        [r(f"COALESCE({c}, m_{c})", c) for c in med_cols]
    o["median_fill"] = duck_with(_basic_sql(f"SELECT {', '.join(cols)} FROM basic, (SELECT {meds} FROM basic)"),
                                 "daily_orders")
    # an empty field of a CSV file is missing
    text = lambda f: f"NULLIF({f.name}, '') AS {f.name}" if f.dataType.simpleString() == "string" else f.name
    o["scan_by_name"] = duck_with("SELECT " + ", ".join(text(f) for f in schemas.MASTER.fields) + " FROM master", "master")
    o["promotion_labels"] = duck_with(f"""SELECT restaurant_id, date, total_orders, {r('total_revenue', 'total_revenue')},
  CASE WHEN promotion_flag THEN 'Promotion' WHEN NOT promotion_flag THEN 'No Promotion' END AS promo FROM daily_orders""", "daily_orders")
    o["scan_roundtrip"] = duck_with("SELECT * FROM daily_orders", "daily_orders")
    o["read_if_exists"] = duck_with("SELECT * FROM daily_orders", "daily_orders")
    from . import catalog_analysis
    report = catalog_analysis.oracles()["quality_report"]
    o["quality_report_text"] = (
        "SELECT concat_ws(' | ', dataset, \"check\", concat_ws(': ', COALESCE(\"column\", '-'), "
        "CAST(value AS VARCHAR))) AS value FROM (" + report + ") r")
    hol = " ".join(f"WHEN {m} THEN '{n.replace(chr(39), chr(39) * 2)}'" for m, n in HOLIDAYS)
    mmdd = "(month(date) * 100 + dayofmonth(date))"
    ev = " OR ".join(f"{mmdd} BETWEEN {a} AND {b}" for a, b in EVENT_RANGES)
    o["holiday_event_flags"] = duck_with(f"""SELECT date,
  CAST({mmdd} IN ({", ".join(str(m) for m, _ in HOLIDAYS)}) AS INT) AS is_holiday,
  CASE {mmdd} {hol} END AS holiday_name,
  CAST({ev} AS INT) AS event_flag
FROM (SELECT DISTINCT date FROM daily_orders)""", "daily_orders")
    o["sink_roundtrip"] = duck_with("SELECT *, strftime(date, '%Y-%m') AS month_partition FROM daily_orders",
                                    "daily_orders")
    return o

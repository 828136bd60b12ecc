"""Record rules, quality checks and risk scoring."""
import datetime as dt

from pyspark.sql import functions as F

from paneltide.operators import quality as D
from paneltide.operators import risk as R

ORDERS_DDL = ("restaurant_id long, date date, total_orders long, total_revenue double, avg_discount double, "
              "promotion_flag boolean, cancellation_rate double, avg_delivery_time double")


def test_orders_rules_quarantine(spark):
    rows = [
        (1, dt.date(2024, 1, 1), 5, 100.0, 5.0, False, 0.1, 30.0),     # valid
        (1, dt.date(2030, 1, 1), 5, 100.0, 5.0, False, 0.1, 30.0),     # future date
        (2, dt.date(2024, 1, 2), 0, 50.0, 5.0, False, None, None),     # revenue without orders
        (3, dt.date(2024, 1, 3), -1, 0.0, 150.0, False, 1.5, -2.0),    # several
    ]
    tagged = D.validate(spark.createDataFrame(rows, ORDERS_DDL), D.orders_rules("2025-01-01"))
    valid, quarantine = D.split_valid(tagged)
    assert valid.count() == 1 and quarantine.count() == 3
    counts = {r["rule"]: r["n_violations"] for r in D.rule_counts(tagged).collect()}
    assert counts["date_not_future"] == 1 and counts["zero_orders_zero_revenue"] == 1
    assert counts["_rows"] == 4 and counts["_valid"] == 1
    assert counts["cancellation_0_1"] == 1 and "delivery_nonnegative" in counts


def test_context_rules_day_of_week_mismatch(spark):
    rows = [(dt.date(2024, 1, 1), "X", 0, False, False, 1, "Clear", False),     # Monday, fine
            (dt.date(2024, 1, 1), "Y", 3, False, False, 1, "Fog", False)]        # wrong dow + label
    tagged = D.validate(spark.createDataFrame(
        rows, "date date, city string, day_of_week int, is_weekend boolean, is_holiday boolean, month int, "
              "weather string, event_flag boolean"), D.context_rules())
    bad = tagged.where(F.size("violations") > 0).first()["violations"]
    assert set(bad) == {"day_of_week_matches_date", "weather_label"}


def test_duplicates_continuity_missing(spark):
    m = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "restaurant_id long")
    assert D.duplicate_ids(m).first()[0] == 2
    d = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 4)), (2, dt.date(2024, 1, 1))],
                              "restaurant_id long, date date")
    cont = D.date_continuity(d).collect()
    assert len(cont) == 1 and cont[0]["n_missing"] == 2
    assert D.missing_dates(d).count() == 2


def test_risk_score_level_bounds(spark):
    df = spark.createDataFrame([(10.0, 9.0, 10.5), (1.0, 0.8, 1.5), (-1.0, -2.0, 0.0), (4.0, 5.0, 3.0)],
                               "prediction double, lower_bound double, upper_bound double")
    lo, hi = R.bounded("prediction", "lower_bound", "upper_bound")
    b = df.select("prediction", lo.alias("lower_bound"), hi.alias("upper_bound"))
    out = b.select(R.risk_score().alias("s"), R.risk_level(R.risk_score()).alias("l"), "lower_bound",
                   "upper_bound").collect()
    assert out[0]["l"] == "Low Risk" and abs(out[0]["s"] - 1.5 / 11) < 1e-12
    assert out[1]["l"] == "Medium Risk"
    assert out[2]["s"] is None and out[2]["l"] is None          # point = -1 -> NULL, not inf
    assert out[3]["lower_bound"] == 4.0 and out[3]["upper_bound"] == 4.0


def _scored_sample(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        p = float(rng.integers(1, 30))
        lo, hi = p - float(rng.integers(0, 5)), p + float(rng.integers(0, 12))
        rows.append((int(i % 7), dt.date(2024, 1, 1) + dt.timedelta(days=i // 7), int(rng.integers(0, 40)),
                     p, lo, hi, "Holiday" if i % 10 == 0 else "Regular Day"))
    df = spark.createDataFrame(rows, "restaurant_id long, date date, total_orders long, prediction double, "
                                     "lower_bound double, upper_bound double, day_type string")
    return R.score(df)


def test_group_quantiles_equal_the_percentile_aggregate(spark):
    from paneltide.operators import explore as A
    from paneltide.operators.columns import median_fill
    s = _scored_sample(spark)

    def check(df, key, names, value, probs, src=s):
        exp = {r[0]: r[1:] for r in src.groupBy(key).agg(*[F.percentile(value, p) for p in probs]).collect()}
        got = {r[0]: r[1:] for r in df.select(df.columns[0], *names).collect()}
        assert got.keys() == exp.keys()
        for k in exp:
            assert all(abs(x - y) < 1e-4 if "median_abs_error" in names else abs(x - y) < 1e-9 for x, y in zip(got[k], exp[k])), k

    check(R.validation_summary(s), "risk_level", ["median_abs_error"], "abs_error", [0.5])
    check(R.risk_holiday_summary(s), "day_type", ["median_risk"], "risk_score", [0.5])
    check(A.box_stats(s, "day_type", "abs_error"), "day_type", ["q1", "median", "q3"], "abs_error", [0.25, 0.5, 0.75])
    check(A.describe_by(s, "day_type", "risk_score"), "day_type", ["median"], "risk_score", [0.5])
    assert abs(A.metric_summary(s, "risk_score").first()["median"] - s.select(F.median("risk_score")).first()[0]) < 1e-9
    holes = s.withColumn("risk_score", F.when(F.col("total_orders") % 3 == 0, None).otherwise(F.col("risk_score")))
    mf = median_fill(holes, ["risk_score"])
    exp = holes.select(F.median("risk_score")).first()[0]
    got = mf.where(F.col("total_orders") % 3 == 0).select(F.min("risk_score"), F.max("risk_score")).first()
    assert abs(got[0] - exp) < 1e-12 and abs(got[1] - exp) < 1e-12
    mr = median_fill(holes, ["risk_score", "abs_error"])
    got2 = mr.where(F.col("total_orders") % 3 == 0).select(F.min("risk_score")).first()[0]
    assert abs(got2 - exp) < 1e-12

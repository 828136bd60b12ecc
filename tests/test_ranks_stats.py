"""Distributed ranks, rank tests, splits and p-values."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.functions import stats as ST
from paneltide.operators import correlation as C
from paneltide.operators import ranks as RK
from paneltide.operators import split as SP


def _tied(n=400, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"x": rng.integers(0, 15, n).astype(float), "y": rng.integers(0, 7, n).astype(float),
                         "g": rng.integers(0, 2, n)})


def test_average_ranks_match_pandas_with_buckets(spark):
    pdf = _tied()
    df = spark.createDataFrame(pdf)
    for buckets in (1, 3, 256):
        got = RK.with_rank(df, "x", "rx", buckets=buckets).toPandas()
        exp = pdf.assign(rx=pdf["x"].rank(method="average"))
        m = got.groupby("x")["rx"].first().sort_index()
        e = exp.groupby("x")["rx"].first().sort_index()
        assert np.allclose(m.values, e.values)


def test_spearman_equals_rank_correlation(spark):
    pdf = _tied()
    row = C.spearman(spark.createDataFrame(pdf), "x", "y").first()
    exp = pdf["x"].rank().corr(pdf["y"].rank())
    assert math.isclose(row["rho"], exp, rel_tol=1e-12) and row["n"] == len(pdf)


def test_mann_whitney_u_brute_force(spark):
    pdf = _tied(120, seed=5)
    a = pdf.loc[pdf.g == 1, "x"].to_numpy()
    b = pdf.loc[pdf.g == 0, "x"].to_numpy()
    u_brute = sum((ai > bi) + 0.5 * (ai == bi) for ai in a for bi in b)
    row = C.mann_whitney(spark.createDataFrame(pdf), "x", "g", 1).first()
    assert math.isclose(row["u1"], u_brute)
    z, p = ST.mann_whitney_p_value(row["u1"], row["n1"], row["n2"], row["tie_term"])
    assert 0.0 <= p <= 1.0


def test_betainc_and_pearson_p():
    assert math.isclose(ST.betainc(1.0, 1.0, 0.3), 0.3, rel_tol=1e-12)
    assert math.isclose(ST.betainc(2.5, 1.0, 0.4), 0.4 ** 2.5, rel_tol=1e-10)
    assert math.isclose(ST.pearson_p_value(0.0, 50), 1.0, rel_tol=1e-12)
    # t = 2.0106 with 48 dof is the two-sided 5% point
    r = 2.0106348 / math.sqrt(48 + 2.0106348 ** 2)
    assert math.isclose(ST.pearson_p_value(r, 50), 0.05, rel_tol=1e-3)


def _panel(spark, same_date_rows=10):
    rows = []
    d0 = dt.date(2024, 1, 1)
    for day in range(20):
        for rid in range(1, 4):
            rows.append((rid, d0 + dt.timedelta(days=day)))
    for rid in range(10, 10 + same_date_rows):
        rows.append((rid, d0 + dt.timedelta(days=15)))
    return spark.createDataFrame(rows, "restaurant_id long, date date"), pd.DataFrame(rows, columns=["restaurant_id", "date"])


def test_time_split_matches_sorted_cut(spark):
    sdf, pdf = _panel(spark)
    for ts in (0.2, 0.35, 0.5):
        got = SP.time_split(sdf, ts).toPandas()
        srt = pdf.sort_values(["date", "restaurant_id"]).reset_index(drop=True)
        k = int(len(srt) * (1 - ts))
        exp = set(map(tuple, srt.iloc[:k][["restaurant_id", "date"]].to_numpy()))
        tr = set(map(tuple, got[got.split == "train"][["restaurant_id", "date"]].to_numpy()))
        assert tr == exp and len(got) == len(pdf)


def test_entity_split_matches_sorted_cut(spark):
    sdf, pdf = _panel(spark)
    got = SP.entity_split(sdf, 0.2).toPandas()
    srt = pdf.sort_values(["restaurant_id", "date"]).reset_index(drop=True)
    k = int(len(srt) * 0.8)
    exp = set(map(tuple, srt.iloc[:k][["restaurant_id", "date"]].to_numpy()))
    assert set(map(tuple, got[got.split == "train"][["restaurant_id", "date"]].to_numpy())) == exp


def test_exact_quantiles_match_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": np.round(rng.normal(0, 1, 500), 2)})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for accuracy in (10, 60, 10_000):
        one = RK.exact_quantiles(df, "v", probs, accuracy=accuracy).first()
        exp = pdf["v"].quantile(probs).to_numpy()
        assert np.allclose([one[f"q{i}"] for i in range(5)], exp)
        grp = RK.exact_quantiles(df, "v", probs, by=["g"], accuracy=accuracy).toPandas().set_index("g")
        for g, sub in pdf.groupby("g"):
            assert np.allclose(grp.loc[g, [f"q{i}" for i in range(5)]].to_numpy(float),
                               sub["v"].quantile(probs).to_numpy())


def test_missing_values_and_null_groups_of_quantiles(spark):
    """NaN and NULL are missing, a NULL group is a group, and the sketch's accuracy changes nothing."""
    rows = [(None, 1.0), (None, 3.0), ("a", float("nan")), ("a", 5.0), ("a", None), ("b", None), ("c", float("inf")), ("c", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for accuracy in (10, 60, 10_000):
        got = {r["g"]: r["q0"] for r in RK.exact_quantiles(df, "v", [0.5], by=["g"], accuracy=accuracy).collect()}
        assert got == {None: 2.0, "a": 5.0, "c": float("inf")}
    empty = RK.exact_quantiles(df.where("false"), "v", [0.25, 0.5]).collect()
    assert [tuple(r) for r in empty] == [(None, None)]


def test_histogram_has_empty_bins(spark):
    from paneltide.operators.explore import histogram

    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (None,), (float("nan"),)], "v double")
    got = {r["bin"]: r["count"] for r in histogram(df, "v", 10).collect()}
    assert got == {0: 2, 9: 1, **{i: 0 for i in range(1, 9)}}
    assert histogram(df.where("false"), "v", 10).count() == 0


def test_quantile_values_of_many_columns(spark):
    """Columns that the sketch settles, columns that it doesn't, and columns without values; any size gives pandas' numbers."""
    rng = np.random.default_rng(12)
    n = 20_000
    pdf = pd.DataFrame({"few": rng.integers(0, 5, n).astype(float), "many": rng.normal(0, 1, n), "tail": rng.lognormal(0, 2, n), "same": 7.0})
    pdf.loc[rng.random(n) < 0.3, "many"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double")).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (100, 2_000, 10_000):
        got = RK.quantile_values(df, ["few", "many", "tail", "same", "none"], probs, accuracy=accuracy)
        for c in pdf.columns:
            assert np.allclose(got[c], pdf[c].quantile(probs).to_numpy(), rtol=1e-12), (c, accuracy)
        assert got["none"] == [None] * len(probs)
    small = df.limit(7).persist()
    assert RK.quantile_values(small, ["many"], [0.5])["many"] == [pytest.approx(small.toPandas()["many"].median())]


def test_quality_report_plan_is_small(spark):
    """The quartiles stand in the plan as numbers: a handful of Exchanges, no Window."""
    import datetime as dt

    from paneltide.operators.quality import quality_report

    daily = spark.createDataFrame([(1, dt.date(2024, 1, 1 + i), float(i), 2.0 * i) for i in range(20)], "restaurant_id long, date date, total_orders double, total_revenue double")
    master = spark.createDataFrame([(1, "a"), (1, None)], "restaurant_id long, city string")
    context = spark.createDataFrame([(dt.date(2024, 1, 1), "a")], "date date, city string")
    out = quality_report(master, daily, context)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 10 and "Window" not in plan
    got = {(r["dataset"], r["check"], r["column"]): r["value"] for r in out.collect()}
    assert got["restaurants", "duplicate_ids", "restaurant_id"] == 1 and got["restaurants", "missing_values", None] == 1
    assert got["daily_orders", "iqr_outliers", "total_orders"] == 0 and len(got) == 9


def test_quantiles_of_wide_tables_keep_only_rows_between_the_sketch_sides(spark, monkeypatch):
    """every value of every column became a row."""
    monkeypatch.setattr(RK, "exact_quantiles", lambda *a, **k: 1 / 0)
    rng = np.random.default_rng(5)
    for n in (10_000, 30_001):
        a, b, c = rng.normal(0, 1, n), np.round(rng.normal(0, 300, n)), rng.random(n)
        pdf = pd.DataFrame({"a": a, "b": b, "c": np.where(c < 0.3, np.nan, c) if n > 20_000 else c})
        got = RK.quantile_values(spark.createDataFrame(pdf).repartition(5), ["a", "b", "c"], [0.0, 0.25, 0.5, 0.99, 1.0])
        for name in pdf:
            assert np.allclose(got[name], pdf[name].quantile([0.0, 0.25, 0.5, 0.99, 1.0]), rtol=0, atol=1e-12)

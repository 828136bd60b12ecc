"""CSV by header name, cleaned and quarantined records, labels, and the profile of a wide table."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide import schemas
from paneltide.functions.scalar import label_flag
from paneltide.operators import correlation as C
from paneltide.operators import explore as A
from paneltide.operators import quality as D
from paneltide.sources import files as S

SCHEMA = T.StructType([T.StructField("restaurant_id", T.LongType()), T.StructField("date", T.DateType()), T.StructField("rate", T.DoubleType()),
                       T.StructField("flag", T.BooleanType()), T.StructField("name", T.StringType())])


def _write(tmp_path, text, name="a.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def test_columns_are_bound_by_name(spark, tmp_path):
    path = _write(tmp_path, "﻿Name , Rate,Extra,DATE,Restaurant ID,Flag\n x y ,1.5,e,2024-02-03,7,True\n,,,,,\n\"q, r\",-2,f,2024-02-04,8,false\n")
    rows = S.read_csv(spark, path, SCHEMA).collect()
    assert [tuple(r) for r in rows] == [(7, dt.date(2024, 2, 3), 1.5, True, " x y "), (None, None, None, None, None), (8, dt.date(2024, 2, 4), -2.0, False, "q, r")]
    extra = S.read_csv(spark, path, SCHEMA, keep_extra=True)
    assert extra.columns == [*SCHEMA.names, "extra"] and [r["extra"] for r in extra.collect()] == ["e", None, "f"]
    assert S.read_csv(spark, path).columns == ["name", "rate", "extra", "date", "restaurant_id", "flag"]


def test_absent_columns_and_unreadable_fields(spark, tmp_path):
    path = _write(tmp_path, "date,restaurant_id\n2024-01-01,1\nnonsense,2\n2024-13-45,x\n2024-01-02\n2024-01-03,4,surplus\n")
    rows = S.read_csv(spark, path, SCHEMA, keep_corrupt=True).collect()
    assert [(r["restaurant_id"], r["date"], r["name"]) for r in rows] == [(1, dt.date(2024, 1, 1), None), (2, None, None), (None, None, None), (None, dt.date(2024, 1, 2), None), (4, dt.date(2024, 1, 3), None)]
    assert [r["_corrupt_record"] for r in rows] == [None, "nonsense,2", "2024-13-45,x", "2024-01-02", "2024-01-03,4,surplus"]
    assert S.read_csv(spark, _write(tmp_path, "date,restaurant_id\n", "b.csv"), SCHEMA).count() == 0


def test_another_header_in_the_folder_is_an_error(spark, tmp_path):
    _write(tmp_path, "restaurant_id,name\n1,a\n", "1.csv")
    _write(tmp_path, "name,restaurant_id\nb,2\n", "2.csv")
    with pytest.raises(Exception, match="(?i)header"):
        S.read_csv(spark, str(tmp_path), SCHEMA).collect()


def test_records_are_cleaned_or_quarantined(spark):
    rows = [(1, dt.date(2024, 1, 1), 2, 10.0, None, None, None, None), (2, dt.date(2030, 1, 1), 2, 10.0, None, True, None, None), (0, dt.date(2024, 1, 1), 0, 5.0, 3.0, False, 2.0, -1.0)]
    got = {r["restaurant_id"]: r for r in D.records(spark.createDataFrame(rows, schemas.DAILY_ORDERS), D.orders_rules("2024-12-31"), D.clean_orders).collect()}
    assert got[1]["status"] == "valid" and got[1]["avg_discount"] == 0.0 and got[1]["promotion_flag"] is False and got[1]["cancellation_rate"] is None and got[1]["violations"] == []
    assert got[2]["status"] == "quarantined" and got[2]["avg_discount"] is None and got[2]["violations"] == ["date_not_future"]
    assert got[0]["violations"] == ["restaurant_id_positive", "cancellation_0_1", "delivery_nonnegative", "zero_orders_zero_revenue"]
    context = spark.createDataFrame([(dt.date(2024, 1, 1), "\t Rome x ", 0, False, None, 1, None, None)], schemas.EXTERNAL_CONTEXT)
    r = D.records(context, D.context_rules(), D.clean_context).first()
    assert (r["city"], r["weather"], r["is_holiday"], r["event_flag"]) == ("Rome x", "Unknown", False, False)
    master = spark.createDataFrame([(1, "n", 1, " A ", None, 0.0, 0.0, " x ,, y", 1.0, "EUR", None, "Yes", None, None, 1, 3.0, 5)], schemas.MASTER)
    r = D.records(master, D.master_rules(), D.clean_master).first()
    assert (r["city"], r["locality"], r["cuisines"], r["has_table_booking"], r["has_online_delivery"]) == ("A", "", "x, y", "No", "Yes")


def test_labels(spark):
    df = spark.createDataFrame([("True",), ("true",), ("1",), ("False",), ("0",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in df.select(label_flag("v", "Y", "N")).collect()] == ["Y", "Y", "Y", "N", "N", None, None]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,), (None,)], "v boolean").select(label_flag("v", "Y", "N")).collect()] == ["Y", "N", None]


def test_profile_of_a_wide_table(spark):
    """Distinct counts of many columns without expanding the rows to one wide row a column."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({f"c{i}": rng.integers(0, i + 2, 200) for i in range(50)})
    df = spark.createDataFrame(pdf).withColumns({"none": F.lit(None).cast("string"), "zero": F.when(F.col("c0") == 0, F.lit(0.0)).otherwise(F.lit(-0.0)), "nan": F.lit(float("nan")),
                                                 "list": F.array("c0", "c1"), "bytes": F.encode(F.col("c2").cast("string"), "UTF-8"), "day": F.lit(dt.date(2024, 1, 1))})
    out = A.profile_columns(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    got = {r["column"]: r for r in out.collect()}
    assert all(got[c]["n_distinct"] == pdf[c].nunique() for c in pdf.columns)
    assert (got["none"]["n_distinct"], got["none"]["n_null"], got["none"]["null_pct"]) == (0, 200, 100.0)
    assert got["zero"]["n_distinct"] == 1 and got["nan"]["n_distinct"] == 1 and got["day"]["dtype"] == "date"
    assert got["list"]["n_distinct"] == len(set(zip(pdf["c0"], pdf["c1"], strict=True))) and got["bytes"]["n_distinct"] == pdf["c2"].nunique()


def test_spearman_of_counts_equals_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"y": rng.integers(0, 6, 400).astype(float), "a": rng.normal(0, 1, 400), "b": rng.integers(0, 3, 400).astype(float), "same": 1.0})
    pdf["c"] = pdf["y"] * 2 + rng.integers(0, 3, 400)
    pdf.loc[::7, "b"] = np.nan
    clean = pdf.astype(object).where(pdf.notna(), None)
    df = spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], "y double, a double, b double, same double, c double")
    got = {r["feature"]: r for r in C.spearman_many(df, "y", ["a", "b", "c", "same"]).collect()}
    for c in ("a", "b", "c"):
        own = pdf[["y", c]].dropna()
        assert got[c]["n"] == len(own) and got[c]["rho"] == pytest.approx(own["y"].rank().corr(own[c].rank()), abs=1e-12)
    assert got["same"]["rho"] is None

"""Static features, scalar helpers and fills against pandas semantics."""
import numpy as np
import pandas as pd

from paneltide.functions import scalar as S
from paneltide.operators import columns as P
from paneltide.operators import joins as J
from paneltide.operators.static import static_features

MASTER_DDL = ("restaurant_id long, restaurant_name string, country_code int, city string, locality string, "
              "longitude double, latitude double, cuisines string, average_cost_for_two double, currency string, "
              "has_table_booking string, has_online_delivery string, is_delivering_now string, "
              "switch_to_order_menu string, price_range int, aggregate_rating double, votes long")


def _master(spark):
    rows = [
        (1, "a", 1, "X", "", 0.0, 0.0, None, 100.0, "INR", "Yes", "no", "maybe", "No", 2, 4.5, 10),
        (2, "b", 2, "X", "", 0.0, 0.0, " , Cafe,,Indo Chinese ", 300.0, "INR", "yes", "Yes", "No", "No", 0, 0.0, 0),
        (3, "c", 1, None, "", 0.0, 0.0, "North Indian, Chinese", None, "INR", "No", "No", "Yes", "No", 3, None, 50),
        (3, "d", 1, "Y", "", 0.0, 0.0, "Italian", 500.0, "INR", None, "No", "No", "No", None, 3.0, None),
    ]
    return spark.createDataFrame(rows, MASTER_DDL)


def test_static_features_edge_cases(spark):
    got = static_features(_master(spark)).toPandas().sort_values(["restaurant_id", "city"], na_position="first")
    got = got.reset_index(drop=True)
    r1 = got[got.restaurant_id == 1].iloc[0]
    assert r1.has_table_booking == 1 and r1.has_online_delivery == 0 and r1.is_delivering_now == 0
    assert r1.cuisine_count == 0 and r1.cuisine_diversity == 0.0
    r2 = got[got.restaurant_id == 2].iloc[0]
    assert r2.cuisine_count == 2                      # " , Cafe,,Indo Chinese " -> Cafe, Indo Chinese
    assert r2.has_chinese == 1 and r2.has_cafe == 1  # substring match
    assert r2.cuisine_diversity == round(np.log2(2), 4)
    assert r2.cost_per_price_range == 0.0             # price_range 0 -> 0
    assert r2.rating_tier == "unrated" and r2.is_unrated == 1
    r3 = got[(got.restaurant_id == 3) & got.city.isna()].iloc[0]
    assert r3.rating_tier == "excellent"              # NULL rating falls to the last branch
    assert pd.isna(r3.city_restaurant_count)          # NULL city -> NULL count
    assert r3.is_high_cost == 0                       # NULL cost compares false
    # q75 of cost (linear interpolation over 100, 300, 500) = 400
    assert list(got.sort_values("average_cost_for_two").is_high_cost) == [0, 0, 1, 0]
    x = got[got.city == "X"]
    assert (x.city_restaurant_count == 2).all() and np.allclose(x.city_freq, 0.5)
    assert "switch_to_order_menu" not in got.columns and "cuisines" not in got.columns


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in [-1.0, 0.0, 5.0, 5.0001, 10.0, 20.0, 100.0, 101.0]], "v double")
    label, _ = S.right_closed_bin("v", [0, 5, 10, 20, 100])
    got = [r[0] for r in df.select(label).collect()]
    exp = pd.cut(pd.Series([-1.0, 0.0, 5.0, 5.0001, 10.0, 20.0, 100.0, 101.0]), [0, 5, 10, 20, 100]).astype(str)
    exp = [None if e == "nan" else e for e in exp]
    assert [g is None for g in got] == [e is None for e in exp]
    assert got[2] == "(0, 5]" and got[3] == "(5, 10]"


def test_median_fill_even_count_is_pandas_median(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, None), (3.0, 3), (4.0, 4), (None, 2)], "a double, b long")
    got = P.median_fill(df, ["a", "b"]).toPandas()
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, None], "b": [1, None, 3, 4, 2]})
    exp = pdf.fillna(pdf.median(numeric_only=True))
    assert np.allclose(got["a"], exp["a"]) and np.allclose(got["b"], exp["b"])
    assert got["a"].iloc[4] == 2.5


def test_flag_coercion_and_weather(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([("True", True, "Rainy"), ("False", False, None), (None, None, "Fog")],
                               "s string, b boolean, w string")
    got = df.select(J.flag_to_int("s", T.StringType()).alias("s"), J.flag_to_int("b", T.BooleanType()).alias("b"),
                    J.weather_code("w").alias("w")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 2), (0, 0, 5), (0, 0, 5)]


def test_normalise_names():
    assert P.normalise_name("\ufeffRestaurant ID ") == "restaurant_id"
    assert P.normalise_name(" Average Cost for two", spaces_to_underscore=False) == "average cost for two"


def test_yes_no_never_casts(spark):
    df = spark.createDataFrame([("Yes",), ("yes",), ("YES",), ("No",), (None,)], "c string")
    assert [r[0] for r in df.select(S.yes_no_flag("c")).collect()] == [1, 1, 0, 0, 0]


def test_static_percentiles_equal_the_aggregate(spark):
    from pyspark.sql import functions as F

    from paneltide.operators.ranks import column_quantiles
    m = _master(spark)
    got = {r["column"]: r["q0"] for r in column_quantiles(m, ["average_cost_for_two", "votes"], [0.75]).collect()}
    exp = m.select(F.percentile("average_cost_for_two", 0.75), F.percentile("votes", 0.75)).first()
    assert [got["average_cost_for_two"], got["votes"]] == list(exp)
    assert static_features(m).count() == m.count()

"""Per-entity time-series window features.

Every feature here is a window expression over the same specification
``PARTITION BY restaurant_id ORDER BY date`` with a ROWS frame that ends at
the current row.  Building them as one ``select`` lets Catalyst put all of
them (but the exponential mean, which takes a few more windows of the same order)
in a single Window operator behind one Exchange and one Sort.

Lags are *row* lags (the previous row of the entity, not the previous
calendar day), as in the reference.  Densify the series first
(``joins.dense_spine``) when calendar lags are wanted.

Scale: with a unique (entity, date) key a series holds at most one row per
calendar day, so one window partition is bounded by the length of the
calendar (a few thousand rows for decades of data) however large the panel
grows; the panel's size comes from the number of entities, which spreads
over the shuffle partitions.  The exponential mean is exact for any span
and length: it folds its own block of rows and the finished blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ENTITY = "restaurant_id"
DATE = "date"

# Fixed values of the temporal feature set.
ORDER_LAGS = [1, 2, 3, 7, 14, 21, 28]
REVENUE_LAGS = [1, 7, 14]
ROLLING_WINDOWS = [7, 14, 30]
REVENUE_ROLLING_WINDOWS = [7, 14]
BASIC_LAGS = [1, 7, 14]
ROLLING_STATS = ["mean", "std", "min", "max"]

#: Rows of a block of the exponential mean; any number gives the same means.
EWM_BLOCK = 32


def series_window(entity: str = ENTITY, order: str = DATE) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(order)


def trailing(w: WindowSpec, n: int, leak_safe: bool = False) -> WindowSpec:
    """Frame of the current row and the ``n-1`` rows before it; with
    ``leak_safe`` the ``n`` rows before the current one (today excluded)."""
    if leak_safe:
        return w.rowsBetween(-n, -1)
    return w.rowsBetween(-(n - 1), Window.currentRow)


def lag_columns(col: str, lags: Iterable[int], prefix: str,
                w: WindowSpec | None = None) -> list[Column]:
    w = w or series_window()
    return [F.lag(F.col(col).cast("double"), k).over(w).alias(f"{prefix}{k}") for k in lags]


def rolling_stat(col: str, n: int, stat: str, w: WindowSpec | None = None,
                 min_periods: int = 1, leak_safe: bool = False) -> Column:
    """Rolling statistic over the last ``n`` rows including the current one.

    ``min_periods`` follows pandas: fewer non-null values in the frame than
    that gives NULL.  ``std`` is the sample deviation (one value -> NULL).
    """
    w = trailing(w or series_window(), n, leak_safe)
    x = F.col(col).cast("double")
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
           "sum": F.sum}[stat](x).over(w)
    if min_periods <= 1:
        return agg
    return F.when(F.count(x).over(w) >= min_periods, agg)


def rolling_columns(col: str, windows: Iterable[int], stats: Sequence[str], prefix: str,
                    w: WindowSpec | None = None, min_periods: int = 1, leak_safe: bool = False) -> list[Column]:
    short = {"mean": "rmean", "std": "rstd", "min": "rmin", "max": "rmax", "sum": "rsum"}
    out = []
    for n in windows:
        for s in stats:
            out.append(rolling_stat(col, n, s, w, min_periods, leak_safe).alias(f"{prefix}{short[s]}_{n}"))
    return out


def diff_column(col: str, k: int, w: WindowSpec | None = None) -> Column:
    w = w or series_window()
    x = F.col(col).cast("double")
    return x - F.lag(x, k).over(w)


def with_ewm(df: DataFrame, means: Sequence[tuple[str, int, str]], w: WindowSpec | None = None, leak_safe: bool = False,
             block: int = EWM_BLOCK) -> DataFrame:
    """``df`` with exponentially weighted means (pandas ``ewm(span, adjust=False)``): ``means`` holds (column, span, name).

    ``y0 = x0``, ``yt = (1-a) y(t-1) + a xt`` with ``a = 2/(span+1)``, over the whole series whatever its length and span.
    A NULL or NaN ages the mean, as pandas does: after g of them, with ``v = (1-a)**(g+1)``, ``yt = (v y + a xt) / (v + a)``; at a missing value
    the mean so far stands, before the first value NULL.  ``leak_safe``: the mean up to the previous row.

    Spark has no recursive window function.  A row is an affine map ``y -> b y + c``;
    the maps of a block of rows compose to one map.  So a row folds the rows of its own block, starting from the fold of
    the finished blocks: ``block + n / block`` steps for the n-th row.  All windows share one partitioning and order (one
    Exchange, one Sort).
    """
    w = w or series_window()
    before, head = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-(block - 1), Window.currentRow)
    out = df.withColumn("_t", F.row_number().over(w) - 1)
    inputs = list(dict.fromkeys(c for c, _, _ in means))
    value = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in inputs}
    out = out.select("*", *[F.last(F.when(value[c].isNotNull(), F.col("_t")), ignorenulls=True).over(before).alias(f"_seen{i}") for i, c in enumerate(inputs)])
    maps = []
    for k, (c, span, _) in enumerate(means):
        a = 2.0 / (span + 1.0)
        x, seen = value[c], F.col(f"_seen{inputs.index(c)}")
        gap = F.col("_t") - seen
        old = F.when(gap == 1, F.lit(1.0 - a)).otherwise(F.pow(F.lit(1.0 - a), gap))
        total = F.when(gap == 1, F.lit(1.0)).otherwise(old + F.lit(a))  # without a gap the weights are 1-a and a
        maps.append(F.struct((F.floor(F.col("_t") / block)).alias("block"),
                             F.when(x.isNull(), 1.0).when(seen.isNull(), 0.0).otherwise(old / total).alias("b"),
                             F.when(x.isNull(), 0.0).when(seen.isNull(), x).otherwise(x * F.lit(a) / total).alias("c")).alias(f"_map{k}"))
    out = out.select("*", *maps)
    own = lambda k: F.filter(F.collect_list(f"_map{k}").over(head), lambda m: m["block"] == F.floor(F.col("_t") / block))
    out = out.select("*", *[own(k).alias(f"_own{k}") for k in range(len(means))])
    one = F.struct(F.lit(1.0).alias("b"), F.lit(0.0).alias("c"))
    whole = lambda k: F.aggregate(f"_own{k}", one, lambda m, r: F.struct((m["b"] * r["b"]).alias("b"), (m["c"] * r["b"] + r["c"]).alias("c")))
    ended = F.col("_t") % block == block - 1
    out = out.select("*", *[F.collect_list(F.when(ended, whole(k))).over(before).alias(f"_done{k}") for k in range(len(means))])
    fold = lambda maps, start: F.aggregate(maps, start, lambda y, m: y * m["b"] + m["c"])
    found = []
    for k, (c, _, name) in enumerate(means):
        y = F.when(value[c].isNotNull() | F.col(f"_seen{inputs.index(c)}").isNotNull(), fold(f"_own{k}", fold(f"_done{k}", F.lit(0.0))))
        found.append(y.alias(name))
    out = out.select("*", *found)
    if leak_safe:
        out = out.withColumns({name: F.lag(name).over(w) for _, _, name in means})
    return out.select(*df.columns, *[name for _, _, name in means])


def momentum(col: str, n: int = 7, w: WindowSpec | None = None) -> Column:
    """``(x - rolling_mean_n) / (rolling_mean_n + 1)``."""
    m = rolling_stat(col, n, "mean", w)
    return F.try_divide(F.col(col).cast("double") - m, m + F.lit(1.0))


# ---------------------------------------------------------------------------
# Feature groups (each returns columns; ``add`` adds them with one select)
# ---------------------------------------------------------------------------

def order_lag_columns(w: WindowSpec | None = None) -> list[Column]:
    return lag_columns("total_orders", ORDER_LAGS, "orders_lag_", w)


def revenue_lag_columns(w: WindowSpec | None = None) -> list[Column]:
    return lag_columns("total_revenue", REVENUE_LAGS, "revenue_lag_", w)


def order_rolling_columns(w: WindowSpec | None = None, leak_safe: bool = False) -> list[Column]:
    return rolling_columns("total_orders", ROLLING_WINDOWS, ROLLING_STATS, "orders_", w, leak_safe=leak_safe)


def revenue_rolling_columns(w: WindowSpec | None = None, leak_safe: bool = False) -> list[Column]:
    return rolling_columns("total_revenue", REVENUE_ROLLING_WINDOWS, ["mean"], "revenue_", w, leak_safe=leak_safe)


#: The exponential mean of the temporal features: (column, span, name).
TREND_EWM = [("total_orders", 7, "orders_ewm_7")]


def trend_columns(w: WindowSpec | None = None, leak_safe: bool = False) -> list[Column]:
    """Diffs and momentum (the exponential mean: ``with_ewm``).

    ``leak_safe``: the diffs and the momentum contain today's target
    (``diff_1 + lag_1 = target``), so they are dropped.
    """
    if leak_safe:
        return []
    return [
        diff_column("total_orders", 1, w).alias("orders_diff_1"),
        diff_column("total_orders", 7, w).alias("orders_diff_7"),
        diff_column("total_revenue", 1, w).alias("revenue_diff_1"),
        momentum("total_orders", 7, w).alias("orders_momentum_7"),
    ]


def basic_window_columns(w: WindowSpec | None = None) -> list[Column]:
    """Basic set: lag_1/7/14, rolling mean/std over 7 rows, full window only."""
    return lag_columns("total_orders", BASIC_LAGS, "lag_", w) + [
        rolling_stat("total_orders", 7, "mean", w, min_periods=7).alias("rolling_mean_7"),
        rolling_stat("total_orders", 7, "std", w, min_periods=7).alias("rolling_std_7"),
    ]

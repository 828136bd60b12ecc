"""Positional train/test splits without a global sort.

The reference sorts the whole table and cuts at row ``int(n*(1-test))``.
Here the cut is located from counts: rows per sort-key value (dates, or
entities) are aggregated, a prefix sum over those few values finds the key
where the cut falls, and only the rows of that one boundary key need an
order among themselves.  Everything else is a comparison with the boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked_values, with_rank


def _boundary(df: DataFrame, key: str, test_size: float, bounded: bool = False):
    """(split_idx, boundary key value, rows before the boundary key) as scalar columns.

    ``bounded``: the key has a calendar-bounded number of distinct values
    (dates), so its prefix sums need no bucketing pass.
    """
    n = df.select(F.count(F.lit(1))).scalar()
    split_idx = F.floor(n.cast("double") * F.lit(1.0 - test_size)).cast("bigint")
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
    # rows before each key value: bucketed prefix sums, no single-task window
    cum = ranked_values(per_key, key, bounded=bounded)
    b = cum.where((F.col("before") < split_idx) & (F.col("before") + F.col("cnt") >= split_idx)) \
           .select(F.struct(F.col(key).alias("k"), F.col("before").alias("before"))).scalar()
    return split_idx, b


def time_split(df: DataFrame, test_size: float = 0.2, date: str = "date",
               tie: str = "restaurant_id") -> DataFrame:
    """Adds ``split`` = 'train' / 'test'; order = (date, tie), NULL dates last (test).

    Rows before the boundary date are train, after it test; on the boundary
    date the first ``split_idx - before`` rows by ``tie`` are train (their
    position comes from the distributed rank helper, since one date can
    hold every entity).
    """
    split_idx, b = _boundary(df, date, test_size, bounded=True)
    on_b = df.where(F.col(date) == b["k"])
    # equal ties share an average rank: each takes its own place around it
    own = Window.partitionBy(tie)
    place = F.row_number().over(own.orderBy(tie)) - (F.count(F.lit(1)).over(own) + 1) / 2
    ranked = with_rank(on_b, tie, "_pos").withColumn("_pos", F.col("_pos") + place)
    inside = ranked.withColumn(
        "split", F.when(b["before"] + F.col("_pos") <= split_idx, "train").otherwise("test")).drop("_pos")
    rest = df.where(~F.col(date).eqNullSafe(b["k"]) | b["k"].isNull()).withColumn(
        "split", F.when(F.col(date) < b["k"], "train").otherwise("test"))
    return rest.unionByName(inside)


def entity_split(df: DataFrame, test_size: float = 0.2, entity: str = "restaurant_id",
                 date: str = "date") -> DataFrame:
    """The notebook's "time-based" split, which really cuts by entity; NULL entities are last (test).

    Order = (entity, date); the boundary entity's rows (one series, bounded
    by the calendar) are ordered by a window partitioned by that entity.
    """
    split_idx, b = _boundary(df, entity, test_size)
    pos = F.row_number().over(Window.partitionBy(entity).orderBy(date))
    on_b = df.where(F.col(entity) == b["k"]).withColumn(
        "split", F.when(b["before"] + pos <= split_idx, "train").otherwise("test"))
    rest = df.where(~F.col(entity).eqNullSafe(b["k"]) | b["k"].isNull()).withColumn(
        "split", F.when(F.col(entity) < b["k"], "train").otherwise("test"))
    return rest.unionByName(on_b)


def time_folds(df: DataFrame, n_folds: int = 5, date: str = "date") -> DataFrame:
    """Expanding-window time-series CV folds over the distinct dates.

    Dates are cut into ``n_folds + 1`` consecutive blocks by their rank;
    fold k trains on blocks 0..k-1 and validates on block k.  Output: one
    row per (fold, date) with role 'train' / 'validation' -- join it to the
    data on date.  The date list is calendar-bounded.
    """
    dates = df.select(date).distinct()
    n_dates = dates.select(F.count(F.lit(1))).scalar()
    rk = F.row_number().over(Window.orderBy(date)) - 1
    blocks = dates.withColumn("_block", F.floor(rk * F.lit(n_folds + 1) / n_dates).cast("int"))
    folds = blocks.select(date, "_block", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    return folds.where(F.col("_block") <= F.col("fold")).select(
        "fold", date, F.when(F.col("_block") == F.col("fold"), "validation").otherwise("train").alias("role"))

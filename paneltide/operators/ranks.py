"""Average ranks and exact quantiles without a global sort.

Ranks: rank statistics (Spearman, Mann-Whitney, positional splits) need, for
each distinct value, the number of values below it.  A window ordered over the
whole table would run in one task, so instead:

1. collapse the rows to distinct values with their counts (a hash
   aggregate; a value holding a third of all rows becomes one row), written once
   to the shared folder;
2. cut the distinct values into ordered buckets of about ``BUCKET_VALUES`` at
   approximate quantiles -- their number grows with the data;
3. bucket totals -> prefix offsets over the bucket list;
4. within each bucket a window partitioned by bucket adds the running
   count.  ``avg_rank = before + (count + 1) / 2`` is the tie-averaged
   1-based rank (scipy / pandas ``rank(method="average")``).

Quantiles: a bounded sketch first says between which two values a quantile
lies; then the rows outside of these ranges only count, and the values inside, a
small share of the rows, are counted one by one.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Distinct values of a bucket of a ranking, about; a bucket is one window partition per group.
BUCKET_VALUES = 100_000
#: Accuracy of sketches: a sketched rank is off by at most one in this number of the rows.
BOUND_ACCURACY = 10_000


def present(value: str | Column) -> Column:
    """A numeric column as double, NaN as NULL: both are missing, as in pandas."""
    c = F.col(value) if isinstance(value, str) else value
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def value_counts(df: DataFrame, value: str, extra_counts: dict[str, Column] | None = None) -> DataFrame:
    """Distinct non-null values with ``cnt`` (and optional conditional counts)."""
    aggs = [F.count(F.lit(1)).alias("cnt")]
    for name, cond in (extra_counts or {}).items():
        aggs.append(F.count_if(cond).alias(name))
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(*aggs)


def numeric_key(df: DataFrame, value: str) -> Column:
    """An order-preserving double for numeric, date and timestamp columns."""
    t = df.schema[value].dataType
    c = F.col(value)
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def with_bucket(counts: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: how many of the ``buckets - 1`` bounds lie below the value (binary search)."""
    if buckets < 2:
        return counts.withColumn("_bucket", F.lit(0))
    probs = [i / buckets for i in range(1, buckets)]
    bounds = counts.select(F.percentile_approx(numeric_key(counts, value), probs, BOUND_ACCURACY)).scalar()
    out = counts.select("*", numeric_key(counts, value).alias("_key"), bounds.alias("_bounds"), F.lit(0).alias("_bucket"))
    at = F.col("_bucket")
    for step in (1 << i for i in reversed(range((buckets - 1).bit_length()))):
        above = F.get("_bounds", at + F.lit(step - 1)) < F.col("_key")
        out = out.withColumn("_bucket", at + F.when(above, step).otherwise(0))
    return out.drop("_key", "_bounds")


def _bucket_offsets(bucketed: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per (group, bucket): ``_bcnt``, ``_offset`` (rows of smaller buckets), ``_n`` (rows of the group)."""
    group = Window.partitionBy(*by)
    below = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*by, "_bucket").agg(F.sum("cnt").alias("_bcnt"))
    return totals.select(*by, "_bucket", "_bcnt", F.coalesce(F.sum("_bcnt").over(below), F.lit(0)).alias("_offset"),
                         F.sum("_bcnt").over(group).alias("_n"))


def _join_offsets(bucketed: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bucketed rows with their bucket's offsets (a NULL group is a group too); buckets without a row go."""
    keys = [F.col(k).alias(f"_o{i}") for i, k in enumerate(by)]
    off = offsets.select(*keys, F.col("_bucket").alias("_ob"), "_offset", "_n")
    if not by:
        off = F.broadcast(off)  # at most one row per bucket
    cond = F.col("_bucket") == F.col("_ob")
    for i, k in enumerate(by):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    return bucketed.join(off, cond).drop("_ob", *[f"_o{i}" for i in range(len(by))])


def _counted_before(value: str, by: Sequence[str]) -> Column:
    """Rows of smaller values in the same bucket."""
    within = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("cnt").over(within), F.lit(0))


def ranked_values(counts: DataFrame, value: str, by: Sequence[str] = (), bounded: bool = False,
                  buckets: int | None = None) -> DataFrame:
    """Add ``before`` (count of smaller values) and ``avg_rank`` to a value-count table.

    ``by``: rank independently within each group (e.g. one ranking per
    feature in a long table); buckets are cut on the pooled values.
    ``bounded``: the values are calendar dates, so that one window over
    them is bounded by the calendar and needs no buckets.
    The count table is written to the shared folder (a job starts here); the buckets hold
    about ``BUCKET_VALUES`` of its rows, or as many as ``buckets`` says.
    """
    by = list(by)
    if not bounded:
        counts = cut_lineage(counts)
        buckets = buckets or -(-counts.count() // BUCKET_VALUES)
    if bounded or buckets < 2:
        out = counts.withColumn("_bucket", F.lit(0)).withColumn("before", _counted_before(value, by))
    else:
        b = with_bucket(counts, value, buckets)
        out = _join_offsets(b, _bucket_offsets(b, by), by)
        out = out.withColumn("before", F.col("_offset") + _counted_before(value, by)).drop("_offset", "_n")
    return out.withColumn("avg_rank", F.col("before").cast("double") + (F.col("cnt").cast("double") + 1.0) / 2.0) \
              .drop("_bucket")


def average_ranks(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """(value, cnt, before, avg_rank) for the non-null values of ``df``."""
    return ranked_values(value_counts(df, value), value, buckets=buckets)


def with_rank(df: DataFrame, value: str, rank_col: str, buckets: int | None = None) -> DataFrame:
    """Attach the tie-averaged rank of ``value`` to every row (NULL -> NULL).

    The join back is on the value; a hot value is one skewed partition on
    the row side, which AQE's skew-join handling splits.
    """
    ranks = average_ranks(df, value, buckets).select(value, F.col("avg_rank").alias(rank_col))
    return df.join(ranks, value, "left")


def _around(probs: Sequence[float], accuracy: int) -> list[float]:
    """Sketch probabilities on both sides of each quantile, further away than the sketch can err."""
    return [min(1.0, max(0.0, q + side * 2.0 / accuracy)) for q in probs for side in (-1, 1)]


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = BOUND_ACCURACY) -> DataFrame:
    """Exact quantiles with pandas' linear interpolation, without a single-task merge.

    ``percentile`` keeps a value->count map per group and merges all maps in
    one task, which grows with the number of distinct values.  Here a sketch (``accuracy``) gives each
    group a range of values around each quantile.  Values inside a range are counted by value, those between ranges
    only in all, with their smallest and largest; the running count
    finds the 0-based positions ``floor(h)`` and ``ceil(h)``, ``h = (n-1)q``.  A group's window holds about ``4 n / accuracy`` rows a quantile.
    NULL and NaN are missing.
    Output: one row per group with ``q<i>`` columns (no group: one row, NULL
    where there are no values); a NULL group is a group.
    """
    by = list(by)
    base = df.select(*by, present(value).alias("_v")).where(F.col("_v").isNotNull())
    ranges = base.groupBy(*by).agg(F.percentile_approx("_v", _around(probs, accuracy), accuracy).alias("_r"))
    if by:
        near = ranges.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(by)], "_r")
        cond = F.lit(True)
        for i, k in enumerate(by):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_g{i}"))
        near = base.join(near, cond).drop(*[f"_g{i}" for i in range(len(by))])
    else:
        near = base.withColumn("_r", ranges.select("_r").scalar())
    low, high = [F.get("_r", F.lit(2 * i)) for i in range(len(probs))], [F.get("_r", F.lit(2 * i + 1)) for i in range(len(probs))]
    inside, below = F.lit(False), F.lit(None).cast("double")
    for lo, hi in zip(low, high, strict=True):
        inside = inside | F.col("_v").between(lo, hi)
        below = F.greatest(below, F.when(hi < F.col("_v"), hi))
    # a value between ranges is filed behind the range below it
    filed = near.select(*by, F.when(inside, F.col("_v")).otherwise(below).alias("_k"), F.when(inside, 0).otherwise(1).alias("_side"), "_v")
    counts = filed.groupBy(*by, "_k", "_side").agg(F.count(F.lit(1)).alias("cnt"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    order = Window.partitionBy(*by).orderBy(F.col("_k").asc_nulls_first(), "_side")
    counts = counts.withColumn("_before", F.coalesce(F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
                   .withColumn("_n", F.sum("cnt").over(Window.partitionBy(*by)))
    h = [(F.col("_n") - 1).cast("double") * F.lit(float(q)) for q in probs]
    at = []
    for i, x in enumerate(h):
        for name, place in ((f"_lo{i}", F.floor(x)), (f"_hi{i}", F.ceil(x))):
            held = (place >= F.col("_before")) & (place < F.col("_before") + F.col("cnt"))
            found = F.when(place == F.col("_before"), F.col("_low")).when(place == F.col("_before") + F.col("cnt") - 1, F.col("_high")) \
                     .when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.raise_error(F.lit("a quantile lies outside of its range")).cast("double"))
            at.append(F.max(F.when(held, found)).alias(name))
    picked = counts.groupBy(*by).agg(F.max("_n").alias("_n"), *at)
    out = []
    for i, x in enumerate(h):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (x - F.floor(x)) * (hi - lo)).alias(f"q{i}"))
    return picked.select(*by, *out)


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str = "exact",
                    accuracy: int = BOUND_ACCURACY) -> dict[str, list[float | None]]:
    """The quantiles of several numeric columns, as numbers (jobs start here)."""
    return quantiles_and_more(df, columns, probs, {}, method, accuracy)[0]


def quantiles_and_more(df: DataFrame, columns: Sequence[str], probs: Sequence[float], more: dict[str, Column], method: str = "exact",
                       accuracy: int = BOUND_ACCURACY) -> tuple[dict[str, list[float | None]], dict]:
    """The quantiles of several numeric columns, and the aggregates ``more`` from the same scan.

    One aggregate sketches all columns at once.  Where the sketch's two sides agree (values that
    many rows share) the quantile is known.  Of the other columns a second scan counts the values below the two sides and
    keeps those between them; columns of few values go through ``exact_quantiles`` together.
    """
    columns = list(dict.fromkeys(columns))
    if not columns and not more:
        return {}, {}
    if method not in ("exact", "approx"):
        raise ValueError("method is exact or approx")
    extra = [c.alias(f"m{i}") for i, c in enumerate(more.values())]
    if method == "approx":
        row = df.agg(*[F.percentile_approx(present(c), list(probs), accuracy).alias(f"c{i}") for i, c in enumerate(columns)], *extra).first()
        return {c: list(row[f"c{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}, {name: row[f"m{i}"] for i, name in enumerate(more)}
    wide = [min(1.0, max(0.0, q + side * 4.0 / accuracy)) for q in probs for side in (-1, 1)]
    row = df.agg(*[F.struct(F.count(present(c)).alias("n"), F.percentile_approx(present(c), wide, accuracy).alias("r")).alias(f"c{i}") for i, c in enumerate(columns)], *extra).first()
    out: dict[str, list] = {}
    open_columns, between = [], []
    for i, c in enumerate(columns):
        n, r = row[f"c{i}"]["n"], row[f"c{i}"]["r"]
        if n == 0:
            out[c] = [None] * len(probs)
        elif r[0::2] == r[1::2] and n >= accuracy:  # with fewer rows the sides may miss the next row
            out[c] = list(r[0::2])
        elif n >= accuracy:
            out[c] = [None] * len(probs)
            between += [(c, k, n, r[2 * k], r[2 * k + 1]) for k in range(len(probs))]
        else:
            open_columns.append(c)
    if open_columns:
        pairs = [F.struct(F.lit(i).alias("i"), present(c).alias("v")) for i, c in enumerate(open_columns)]
        long = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
        for r in exact_quantiles(long, "v", probs, ["i"], accuracy).collect():  # one row a column
            out[open_columns[r["i"]]] = [r[f"q{k}"] for k in range(len(probs))]
    for (c, k, *_), value in zip(between, _between(df, between, probs), strict=True):
        out[c][k] = value
    return out, {name: row[f"m{i}"] for i, name in enumerate(more)}


def _between(df: DataFrame, wanted: Sequence[tuple], probs: Sequence[float]) -> list[float]:
    """The quantile of each (column, number of the quantile, values, low, high) whose place lies between low and high.

    Only the values between the sides are rows of their own, about ``8 n / accuracy`` of a column and quantile.
    """
    if not wanted:
        return []
    inside = F.array(*[F.struct(F.lit(i).alias("i"), F.when(present(c).between(low, high), present(c)).alias("v")) for i, (c, _, _, low, high) in enumerate(wanted)])
    below = df.agg(*[F.count_if(present(c) < low).alias(f"b{i}") for i, (c, _, _, low, _) in enumerate(wanted)]).first()
    kept = df.select(F.explode(F.filter(inside, lambda x: x["v"].isNotNull())).alias("x")).select("x.*")
    counts = kept.groupBy("i", "v").agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    place = [(n - 1) * float(probs[k]) for _, k, n, _, _ in wanted]
    of = lambda numbers: F.get(F.array(*[F.lit(int(x)).cast("long") for x in numbers]), F.col("i"))
    counts = counts.withColumn("_before", of(below[f"b{i}"] for i in range(len(wanted))) + F.coalesce(F.sum("cnt").over(order), F.lit(0)))
    holds = lambda at: F.max(F.when((at >= F.col("_before")) & (at < F.col("_before") + F.col("cnt")), F.col("v")))
    found = {r["i"]: r for r in counts.groupBy("i").agg(holds(of(floor(h) for h in place)).alias("lo"), holds(of(ceil(h) for h in place)).alias("hi")).collect()}
    out = []
    for i, h in enumerate(place):
        r = found.get(i)
        if r is None or r["lo"] is None or r["hi"] is None:
            raise ValueError("a quantile lies outside of its range")
        out.append(r["lo"] if r["lo"] == r["hi"] else r["lo"] + (h - floor(h)) * (r["hi"] - r["lo"]))
    return out


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str = "exact") -> DataFrame:
    """(column, q0, q1, ...) of several numeric columns; ``approx`` uses bounded sketches."""
    found = quantile_values(df, columns, probs, method)
    schema = ", ".join(["column string", *[f"q{i} double" for i in range(len(probs))]])
    return df.sparkSession.createDataFrame([(c, *[None if v is None else float(v) for v in q]) for c, q in found.items()], schema)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """``exact_quantiles``, or ``percentile_approx`` where the caller asks for ``approx``."""
    if method == "exact":
        return exact_quantiles(df, value, probs, by)
    if method != "approx":
        raise ValueError("method is exact or approx")
    return df.groupBy(*by).agg(*[F.percentile_approx(present(value), q, 10000).alias(f"q{i}") for i, q in enumerate(probs)])


def add_group_quantiles(agg: DataFrame, src: DataFrame, by: Sequence[str], value: str,
                        probs: Sequence[float], names: Sequence[str], method: str = "exact") -> DataFrame:
    """Join the quantiles of ``value`` per ``by`` group onto ``agg``.

    The join is null-safe on the group keys (a NULL group is a group too).
    """
    by = list(by)
    q = quantiles(src, value, probs, by, method)
    q = q.select(*[F.col(k).alias(f"_qk{i}") for i, k in enumerate(by)],
                 *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    cond = None
    for i, k in enumerate(by):
        c = agg[k].eqNullSafe(q[f"_qk{i}"])
        cond = c if cond is None else cond & c
    out = agg.join(q, cond, "left")
    return out.drop(*[f"_qk{i}" for i in range(len(by))])

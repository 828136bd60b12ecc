"""Correlation and rank tests.

Every statistic is one global aggregate over the data: ``corr`` skips
pairs with a NULL side, which is pandas' pairwise-complete rule, and one
``agg`` evaluates all column pairs in a single scan (partial aggregation
per task, one tiny final merge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as ST
from ..session import cut_lineage
from .ranks import ranked_values, value_counts


def _pair_name(a: str, b: str) -> str:
    return f"{a}__{b}"


def pearson_matrix(df: DataFrame, columns: Sequence[str], lower_only: bool = False) -> DataFrame:
    """Long table (col_a, col_b, r) of pairwise-complete Pearson r."""
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns)
             if (not lower_only or j < i)]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(_pair_name(a, b))
                   for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{_pair_name(a, b)}`" for a, b in pairs)
    return one.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, r)")


def target_correlation(df: DataFrame, target: str, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Pearson r of each feature with the target, largest |r| first."""
    cols = [c for c in columns if c != target]
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    out = one.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, r)")
    out = out.orderBy(F.abs("r").desc_nulls_last(), "feature")
    return out.limit(top) if top else out


def spearman_many(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Spearman rho of each column with ``target`` in one ranking pass.

    For each column only the rows where it and the target are both
    non-null count (scipy on ``dropna()`` pairs).  One scan counts the different pairs
    (feature, x, y) of all columns; the counts are stored once.  x and y are ranked per feature from their own totals, and rho is the
    correlation of the ranks weighted by the pair counts: rows are never joined or stored.
    """
    cols = [c for c in columns if c != target]
    y = F.col(target).cast("double")
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), y.alias("y")) for c in cols])
    long = df.select(F.inline(each)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = cut_lineage(long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("cnt")))
    sides = [pairs.groupBy("feature", F.lit(s).alias("side"), F.col(s).alias("v")).agg(F.sum("cnt").alias("cnt")) for s in ("x", "y")]
    ranks = ranked_values(sides[0].unionByName(sides[1]), "v", by=["feature", "side"]).select("feature", "side", "v", "avg_rank")
    rx, ry = (ranks.where(F.col("side") == s).select("feature", F.col("v").alias(s), F.col("avg_rank").alias(f"r{s}")) for s in ("x", "y"))
    ranked = pairs.join(rx, ["feature", "x"]).join(ry, ["feature", "y"])
    c, a, b = F.col("cnt").cast("double"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy("feature").agg(F.sum("cnt").alias("n"), F.sum(c * a).alias("sa"), F.sum(c * b).alias("sb"), F.sum(c * a * a).alias("saa"), F.sum(c * b * b).alias("sbb"), F.sum(c * a * b).alias("sab"))
    dev = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    scale = F.sqrt(dev("sa", "saa") * dev("sb", "sbb"))
    # ranks are multiples of a half: less than a quarter is a column of one value, which has no rho
    rho = F.when((dev("sa", "saa") >= 0.25) & (dev("sb", "sbb") >= 0.25), (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / scale)
    return sums.select("feature", "n", rho.alias("rho"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """C3 for one pair: (n, rho) on rows where both sides are non-null."""
    return spearman_many(df, y, [x]).select("n", "rho")


def target_spearman(df: DataFrame, target: str, columns: Sequence[str], min_rows: int = 100) -> DataFrame:
    """Spearman rho of each feature with the target (pairs needing > ``min_rows`` rows)."""
    return spearman_many(df, target, columns).where(F.col("n") > min_rows)


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """C4 (Spark part): r, n and the t statistic; p via ``pearson_p_value``."""
    a = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    one = a.agg(F.corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("r") * F.col("r")))
    return one.select("r", "n", t.alias("t_stat"))


def mann_whitney(df: DataFrame, value: str, group: str, first_label) -> DataFrame:
    """C5 (Spark part): U1, n1, n2, rank sum and tie term of two samples.

    ``group == first_label`` is sample 1, any other non-null group sample 2.
    Ranks come from distinct-value counts (no global sort); the rank sum of
    sample 1 is ``sum(avg_rank * count_in_sample_1)`` over distinct values.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = value_counts(rows, value, {"cnt1": F.col(group) == F.lit(first_label)})
    ranked = ranked_values(counts, value)
    one = ranked.agg(
        F.sum("cnt1").alias("n1"),
        (F.sum("cnt") - F.sum("cnt1")).alias("n2"),
        F.sum(F.col("avg_rank") * F.col("cnt1")).alias("rank_sum_1"),
        F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("tie_term"),
    )
    return one.select(
        "n1", "n2", "rank_sum_1", "tie_term",
        (F.col("rank_sum_1") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u1"),
    )


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line y = slope*x + intercept, with r2 and n."""
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    return df.agg(
        F.regr_slope(yy, xx).alias("slope"),
        F.regr_intercept(yy, xx).alias("intercept"),
        F.regr_r2(yy, xx).alias("r2"),
        F.regr_count(yy, xx).alias("n"),
    )

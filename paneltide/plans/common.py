"""Shared helpers for registered queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def round_half_away(c, digits: int = DIGITS):
    """``sign(x) * floor(|x| * 10^d + 0.5) / 10^d`` on doubles.

    The same arithmetic the DuckDB oracle's ``ROUND(x, d)`` does, and plain
    double math inside codegen (``F.round`` goes through BigDecimal per value).
    """
    p = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(p) + F.lit(0.5)) / F.lit(p)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (both engines sum in different orders)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_away(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, alias: str | None = None, digits: int = DIGITS) -> str:
    """DuckDB: ``ROUND(CAST(expr AS DOUBLE), 6) AS alias``."""
    out = f"ROUND(CAST({expr} AS DOUBLE), {digits})"
    return f"{out} AS {alias}" if alias else out

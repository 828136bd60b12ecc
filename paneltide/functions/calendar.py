"""Calendar scalars (F1-F5, F17-F22) as native Column expressions.

All of them are pure functions of a DateType column, so they run inside
whole-stage codegen and work unchanged on streaming DataFrames.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi

# Weekday labels in the order the reports use (Monday first).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_of_week(d: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6 (``dayofweek`` would be Sunday = 1)."""
    return F.weekday(_c(d)).cast("int")


def is_weekend(d: str | Column) -> Column:
    return (F.weekday(_c(d)) >= 5).cast("int")


def week_of_month(d: str | Column) -> Column:
    return (F.floor((F.dayofmonth(_c(d)) - 1) / 7) + 1).cast("int")


def weekday_name(d: str | Column) -> Column:
    return F.date_format(_c(d), "EEEE")


def cyclical(value: Column, period: float, offset: float = 0.0) -> tuple[Column, Column]:
    """sin / cos of ``2*pi*(value - offset)/period``."""
    angle = F.lit(TWO_PI) * (value - F.lit(offset)) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_columns(d: str | Column = "date") -> list[Column]:
    """The 17 calendar features of the temporal feature set, in order."""
    d = _c(d)
    dow = F.weekday(d)
    month = F.month(d)
    doy = F.dayofyear(d)
    sin_dow, cos_dow = cyclical(dow, 7)
    sin_m, cos_m = cyclical(month, 12, offset=1)
    sin_doy, cos_doy = cyclical(doy, 365)
    return [
        dow.cast("int").alias("day_of_week"),
        F.dayofmonth(d).cast("int").alias("day_of_month"),
        doy.cast("int").alias("day_of_year"),
        F.weekofyear(d).cast("int").alias("week"),
        month.cast("int").alias("month"),
        F.quarter(d).cast("int").alias("quarter"),
        F.year(d).cast("int").alias("year"),
        (dow >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"),
        (d == F.last_day(d)).cast("int").alias("is_month_end"),
        week_of_month(d).alias("week_of_month"),
        sin_dow.alias("sin_day_of_week"),
        cos_dow.alias("cos_day_of_week"),
        sin_m.alias("sin_month"),
        cos_m.alias("cos_month"),
        sin_doy.alias("sin_day_of_year"),
        cos_doy.alias("cos_day_of_year"),
    ]


def basic_calendar_columns(d: str | Column = "date") -> list[Column]:
    """Calendar part of the basic feature set: day_of_week, week, month, year, is_weekend."""
    d = _c(d)
    return [
        F.weekday(d).cast("int").alias("day_of_week"),
        F.weekofyear(d).cast("int").alias("week"),
        F.month(d).cast("int").alias("month"),
        F.year(d).cast("int").alias("year"),
        is_weekend(d).alias("is_weekend"),
    ]


def seasonal_index(d: str | Column = "date", amplitude: float = 0.10, phase_day: int = 280) -> Column:
    """``1 + amplitude * sin(2*pi*(day_of_year - phase_day)/365)``."""
    s, _ = cyclical(F.dayofyear(_c(d)), 365, offset=phase_day)
    return F.lit(1.0) + F.lit(amplitude) * s

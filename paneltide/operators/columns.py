"""Projections, filters and fills."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_name(name: str, spaces_to_underscore: bool = True) -> str:
    """Lower-case, strip, drop a UTF-8 BOM, optionally spaces -> ``_``."""
    n = name.replace("\ufeff", "").lower().strip()
    return n.replace(" ", "_") if spaces_to_underscore else n


def normalise_columns(df: DataFrame, spaces_to_underscore: bool = True) -> DataFrame:
    return df.toDF(*[normalise_name(c, spaces_to_underscore) for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; names not present are ignored (like pandas)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_if_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``DataFrame.drop`` already ignores absent names."""
    return df.drop(*list(names))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns by type; booleans excluded as in pandas."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def filter_date_range(df: DataFrame, start: str, end: str, col: str = "date") -> DataFrame:
    """Inclusive both ends; pushed to the scan when ``col`` is a column."""
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def not_(cond: Column) -> Column:
    """Pandas ``~mask`` where a NaN comparison counted as False."""
    return ~F.coalesce(cond, F.lit(False))


def semi_filter(df: DataFrame, ids: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """Keep rows whose key is in a computed id set (``isin`` at scale)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P10."""
    return df.na.drop(subset=list(subset) if subset else None)


def fill_constant(df: DataFrame, value, subset: Sequence[str] | None = None) -> DataFrame:
    """P12."""
    return df.na.fill(value, subset=list(subset) if subset else None)


def median_fill(df: DataFrame, columns: Sequence[str] | None = None, medians_from: DataFrame | None = None,
                method: str = "exact") -> DataFrame:
    """Fill numeric NULLs and NaNs with column medians.

    ``medians_from`` = the frame whose medians are used (default ``df``
    itself, as the reference does for train and test alike).  The exact
    median is pandas' (mean of the two middle values); ``ml.feature.Imputer``
    would give the lower middle value instead.  The medians are worked out first
    (``ranks.quantile_values``), so the fill is a plain projection.
    ``method="approx"`` uses ``percentile_approx``.
    """
    src = medians_from if medians_from is not None else df
    cols = list(columns) if columns is not None else numeric_columns(df)
    cols = [c for c in cols if c in src.columns]
    if not cols:
        return df
    from .ranks import quantile_values

    return fill_with(df, {c: q[0] for c, q in quantile_values(src, cols, [0.5], method).items()})


def fill_with(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """NULLs and NaNs of the named columns replaced by a number each (None: they stay NULL).

    An integer column becomes double, so that medians of .5 stay, as in pandas.
    """
    from .ranks import present

    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c not in values:
            out.append(F.col(f"`{c}`"))
            continue
        floating = isinstance(types[c], (T.DoubleType, T.FloatType))
        x = F.coalesce(present(F.col(f"`{c}`")), F.lit(values[c]).cast("double"))
        out.append((x.cast(types[c]) if floating else x).alias(c))
    return df.select(*out)


def seeded_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Deterministic sample of ``n`` rows: the ``n`` smallest MD5 values of the keys and the seed.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task
    keeps its own top ``n`` and only those meet on one task, so no full
    sort and no unbounded group.  Sampling is the feature here, so the
    limit stays.
    """
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")

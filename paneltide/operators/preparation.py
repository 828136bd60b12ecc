"""Feature preparation as a fitted, savable stage.

``FeaturePreparation`` learns the medians of the training columns;
its model fills NULLs and NaNs with them and assembles the vector, on any
frame: one request alone is prepared as it is in a batch.  Both are
``pyspark.ml`` stages with ``save`` / ``load``, alone or in a ``Pipeline``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import fill_with
from .ranks import quantile_values


class FeaturePreparation(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns one fill value per input column: the exact median (``fill="median"``), or zero (``fill="zero"``).

    A column without any value is filled with 0.
    """

    fill = Param(Params._dummy(), "fill", "median or zero", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", fill="median"):
        super().__init__()
        self._setDefault(outputCol="features", fill="median")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeaturePreparationModel:
        names, how = self.getInputCols(), self.getOrDefault(self.fill)
        if how not in ("median", "zero"):
            raise ValueError("fill is median or zero")
        found = quantile_values(numeric(dataset, names), names, [0.5]) if how == "median" else {}
        values = [float(found[c][0]) if found.get(c, [None])[0] is not None else 0.0 for c in names]
        return FeaturePreparationModel(inputCols=names, outputCol=self.getOutputCol(), values=values)


class FeaturePreparationModel(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fills the input columns (they become doubles) and adds their vector."""

    values = Param(Params._dummy(), "values", "the fill value of each input column", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", values=None):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def fill_values(self) -> dict[str, float]:
        return dict(zip(self.getInputCols(), self.getOrDefault(self.values), strict=True))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getInputCols()
        filled = fill_with(numeric(dataset, names), self.fill_values())
        return VectorAssembler(inputCols=names, outputCol=self.getOutputCol(), handleInvalid="error").transform(filled)


def numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the named columns as doubles (flags become 0 and 1)."""
    own = set(names)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in own else F.col(f"`{c}`") for c in df.columns])

"""Boosted-tree signal on a prepared training table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    """A fitted model with the names of its features."""

    model: GBTRegressionModel
    features: tuple[str, ...]

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``score``."""
        table = VectorAssembler(inputCols=list(self.features), outputCol="_x").transform(df)
        return self.model.transform(table).drop("_x").withColumnRenamed("prediction", "score")

    @property
    def rounds(self) -> int:
        """Trees kept; fewer than asked for when the valid segment stopped the fit."""
        return self.model.getNumTrees

    def importances(self) -> dict[str, float]:
        """Each feature's share of the gain, all together 1."""
        return dict(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True))


def fit_signal(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    segment: str = "segment",
    rounds: int = 20,
    depth: int = 4,
    rate: float = 0.1,
    seed: int = 42,
) -> Signal:
    """Fit on 'train'; stop early where 'valid' no longer gains."""
    table = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    fitting = table.where(F.col(segment).isin("train", "valid")).select(
        "_x", F.col(label).alias("_y"), (F.col(segment) == "valid").alias("_valid")
    )
    model = GBTRegressor(
        featuresCol="_x", labelCol="_y", validationIndicatorCol="_valid", maxIter=rounds, maxDepth=depth,
        stepSize=rate, subsamplingRate=0.8, seed=seed,
    ).fit(fitting)
    return Signal(model, tuple(features))


def boosted_signal(df: DataFrame, features: Sequence[str], label: str, segment: str = "segment", **settings) -> DataFrame:
    """Fit on 'train', stop early on 'valid', predict 'test'.

    (datetime, instrument, score); ``settings`` are those of ``fit_signal``.
    """
    fitted = fit_signal(df, features, label, segment, **settings)
    return fitted.score(df.where(F.col(segment) == "test")).select("datetime", "instrument", "score")

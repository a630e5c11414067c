"""Feature selection and reduction on encoded columns, and the feature vector."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_double, numeric_columns, ref
from tabsmith.operators.features import date_part_columns
from tabsmith.operators.fitted import ColumnEstimator, FittedColumns
from tabsmith.operators.information import mutual_information, neighbour_information
from tabsmith.operators.stats import summarize


class DatePartsModel(FittedColumns):
    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.fitted:
            out = out.select("*", *date_part_columns(out, c)).drop(c)
        return out


class DateParts(ColumnEstimator):
    """Replace date columns by year, month, day, weekday, hour and weekend flag."""

    def _fit(self, df: DataFrame) -> DatePartsModel:
        return DatePartsModel.of(self.cols)


def variances(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Population variance of each column, None without values."""
    stats = summarize(df, cols, (), moments=2)
    return {c: s.m2 / s.n if s.n else None for c, s in stats.items()}


def low_variance(df: DataFrame, cols: Sequence[str], threshold: float = 1e-5) -> list[str]:
    """Columns whose population variance does not exceed ``threshold``."""
    return _dull(variances(df, cols), threshold)


def _dull(found: Mapping[str, float | None], threshold: float) -> list[str]:
    return [c for c, v in found.items() if v is None or v <= threshold]


def information(df: DataFrame, cols: Sequence[str], target: str, classification: bool, estimator: str = "bins") -> dict[str, float]:
    """Mutual information of each column with the target; ``estimator`` is ``bins`` or ``neighbours``."""
    measure = {"bins": mutual_information, "neighbours": neighbour_information}[estimator]
    scores = {r["feature"]: r["mi"] for r in measure(df, cols, target, classification).collect()}
    return {c: scores.get(c, 0.0) for c in cols}


def best_by_information(df: DataFrame, cols: Sequence[str], target: str, k: int, classification: bool, estimator: str = "bins") -> list[str]:
    """The k columns with most mutual information, in input order; ``estimator`` is ``bins`` or ``neighbours``."""
    if k >= len(cols):
        return list(cols)
    return _leading(information(df, cols, target, classification, estimator), k)


def _leading(scores: Mapping[str, float], k: int) -> list[str]:
    cols = list(scores)
    ranked = sorted(cols, key=lambda c: (-scores[c], cols.index(c)))[:k]
    return [c for c in cols if c in ranked]


class FeatureVectorModel(FittedColumns):
    """The kept columns as one ``features`` vector; the other inputs stay."""

    def _transform(self, df: DataFrame) -> DataFrame:
        f = self.fitted
        names = f["keep"]
        plain = df.withColumns({f"_f{i}": F.coalesce(as_double(c), F.lit(0.0)) for i, c in enumerate(names)})
        out = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(names))], outputCol=f["output"]).transform(plain)
        return out.drop(*[f"_f{i}" for i in range(len(names))])

    @property
    def names(self) -> list[str]:
        return self.fitted["keep"]


class FeatureVector(ColumnEstimator):
    """Drop near-constant columns, keep the most informative, assemble the vector.

    ``inputCols`` are the raw feature columns *before* encoding: every numeric column that
    derives from them and is not in ``exclude`` is a candidate.  ``k`` columns are kept by
    mutual information with ``target``; None keeps all.
    """

    def _fit(self, df: DataFrame) -> FeatureVectorModel:
        return self.fit_measured(df, lambda kind, cols, measure: measure(cols))

    def fit_measured(self, df: DataFrame, measured: Callable) -> FeatureVectorModel:
        """``fit`` where ``measured(kind, cols, measure)`` gives the measure of each column, from ``measure(cols)`` or known before."""
        exclude = self.option("exclude", [])
        target, classification = self.option("target"), self.option("classification", True)
        cols = [c for c in numeric_columns(df, [*exclude, target])]
        spread = measured("variance", cols, lambda some: variances(df, some))
        dull = set(_dull({c: spread[c] for c in cols}, self.option("min_variance", 1e-5)))
        keep = [c for c in cols if c not in dull] or cols
        k = self.option("k")
        if k and k < len(keep):
            scores = measured(f"information:{classification}", keep, lambda some: information(df, some, target, classification))
            keep = _leading({c: scores[c] for c in keep}, k)
        return FeatureVectorModel.of({"keep": keep, "output": self.option("output", "features")})


def reduce_dimensions(df: DataFrame, width: int, threshold: int = 40, variance: float = 0.95, col: str = "features",
                      output: str = "features_pca") -> PipelineModel | None:
    """Centred PCA that keeps ``variance`` of the total when ``width`` exceeds ``threshold``.

    Returns None when the vector is narrow enough.
    """
    if width <= threshold:
        return None
    centre = StandardScaler(inputCol=col, outputCol="_centred", withMean=True, withStd=False).fit(df)
    pca = PCA(k=width, inputCol="_centred", outputCol="_rotated").fit(centre.transform(df))
    share = np.cumsum(pca.explainedVariance.toArray())
    keep = min(width, int(np.searchsorted(share, variance - 1e-12)) + 1)
    cut = VectorSlicer(inputCol="_rotated", outputCol=output, indices=list(range(keep)))
    return PipelineModel([centre, pca, cut])

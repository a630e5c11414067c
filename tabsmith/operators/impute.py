"""Filling gaps: mean, median, mode, constant, nearest neighbours, chained regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import NUMERIC_TYPES, fingerprint, ref
from tabsmith.operators.fitted import ColumnEstimator, FittedColumns, TableModel
from tabsmith.operators.knn import knn_join
from tabsmith.operators.profile import value_counts
from tabsmith.operators.stats import clean_values, null_counts, summarize


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent non-null text of each column, ties to the smallest."""
    if not cols:
        return {}
    # One row per column and task leaves the map side (min over (-count, value)).
    best = value_counts(df, cols).groupBy("column").agg(
        F.min(F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("m"))
    return {r["column"]: r["m"]["value"] for r in best.collect()}


def column_defaults(df: DataFrame, cols: Sequence[str]) -> dict[str, float | str]:
    """Median of numeric columns and mode of the others; 0 for a column without values."""
    numeric = [f.name for f in df.schema if f.name in cols and isinstance(f.dataType, NUMERIC_TYPES)]
    other = [c for c in cols if c in df.columns and c not in numeric]
    stats = summarize(df, numeric, (0.5,), moments=0) if numeric else {}
    found = modes(df, other)
    return {c: stats[c].quantiles.get(0.5, 0.0) if c in stats else found.get(c, 0.0) for c in cols}


def fill_missing_columns(df: DataFrame, defaults: dict[str, float | str]) -> DataFrame:
    """Add the columns of ``defaults`` that the table lacks."""
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


class FillModel(FittedColumns):
    def expressions(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for c, v in self.fitted.items():
            base = ref(c).cast("string") if isinstance(v, str) else clean_values(df, [c])[c]
            out[c] = F.coalesce(base, F.lit(v))
        return out


class Fill(ColumnEstimator):
    """strategy: mean, median, mode (text) or zero.  A column without values fills with 0."""

    def _fit(self, df: DataFrame) -> FillModel:
        strategy = self.option("strategy", "median")
        if strategy == "zero":
            return FillModel.of({c: 0.0 for c in self.cols})
        if strategy == "mode":
            found = modes(df, self.cols)
            return FillModel.of({c: found.get(c, "") for c in self.cols})
        probs = (0.5,) if strategy == "median" else ()
        stats = summarize(df, self.cols, probs, moments=0)
        return FillModel.of({
            c: (s.quantiles[0.5] if strategy == "median" else s.mean) if s.n else 0.0 for c, s in stats.items()})


class KnnFillModel(TableModel):
    """Mean of the k nearest donors that have the value.

    The filled value depends only on the row's numbers, so distinct vectors with gaps are
    looked up once and joined back; rows without gaps never take part.
    """

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, k, means = self.fitted["cols"], self.fitted["k"], self.fitted["means"]
        values = clean_values(df, cols)
        df = df.withColumns({c: values[c] for c in cols})
        _, nulls = null_counts(df.select(*[ref(c) for c in cols]))
        gappy = [c for c in cols if nulls[c]]
        if not gappy:
            return df
        has_gap = F.lit(False)
        for c in gappy:
            has_gap = has_gap | ref(c).isNull()
        names = df.columns
        keyed = df.where(has_gap).withColumn("_id", F.concat_ws(":", *fingerprint(cols)))
        vec = F.array(*[ref(c) for c in cols]).alias("vec")
        donors = self.table.select(F.xxhash64(vec).alias("id"), vec)
        filled = keyed
        for c in gappy:
            at = cols.index(c)
            queries = keyed.where(ref(c).isNull()).select(F.col("_id").alias("id"), vec).dropDuplicates(["id"])
            near = knn_join(queries, donors.withColumn("value", F.get("vec", F.lit(at))).where("value is not null"), k)
            fill = near.groupBy(F.col("q_id").alias("_id")).agg(F.avg("value").alias(f"_fill_{c}"))
            filled = filled.join(fill, "_id", "left")
        done = filled.select(*[
            F.coalesce(ref(c), ref(f"_fill_{c}"), F.lit(means[c])).alias(c) if c in gappy else ref(c) for c in names])
        return df.where(~has_gap).unionByName(done)


class KnnFill(ColumnEstimator):
    """k nearest neighbours (default 5) on the columns themselves."""

    def _fit(self, df: DataFrame) -> KnnFillModel:
        cols = self.cols
        values = clean_values(df, cols)
        stats = summarize(df, cols, (), moments=0)
        wide = df.select(*[values[c].alias(c) for c in cols])
        return KnnFillModel.of(
            {"cols": cols, "k": self.option("k", 5), "means": {c: (s.mean if s.n else 0.0) for c, s in stats.items()}}, wide)


def _replay(x: np.ndarray, gaps: np.ndarray, steps: Sequence[tuple[int, np.ndarray, float]]) -> np.ndarray:
    """Apply regression fills in order; ``steps`` are (column, coefficients, intercept)."""
    for j, coef, intercept in steps:
        rows = gaps[:, j]
        if rows.any():
            x[rows, j] = x[rows] @ coef + intercept
    return x


def _start(pdf: pd.DataFrame, cols: Sequence[str], means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = pdf[list(cols)].to_numpy(dtype=float, copy=True)
    gaps = np.isnan(x)
    return np.where(gaps, means[None, :], x), gaps


class ChainedFillModel(FittedColumns):
    """Replays the fitted regressions on Arrow batches; no shuffle, no growing plan."""

    def _transform(self, df: DataFrame) -> DataFrame:
        f = self.fitted
        cols, means = f["cols"], np.array(f["means"])
        steps = [(s["col"], np.array(s["coef"]), s["intercept"]) for s in f["steps"]]
        values = clean_values(df, cols)
        if not steps:
            return df.withColumns({c: F.coalesce(values[c], F.lit(float(m))) for c, m in zip(cols, means)})

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def fill(s: pd.DataFrame) -> pd.Series:
            s.columns = cols
            x, gaps = _start(s, cols, means)
            return pd.Series(list(_replay(x, gaps, steps)))

        packed = df.withColumn("_filled", fill(F.struct(*[values[c].alias(c) for c in cols])))
        return packed.withColumns({c: F.get("_filled", F.lit(i)) for i, c in enumerate(cols)}).drop("_filled")


def bayesian_ridge(products: np.ndarray, pulls: np.ndarray, square: float, n: float, steps: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Coefficients of a regression whose noise and weight precisions follow from the evidence.

    ``products``, ``pulls`` and ``square`` are the centred sums x x', x y and y y of ``n`` rows, all that the updates need.
    Both precisions have a flat gamma prior (1e-6, 1e-6).
    """
    values, vectors = np.linalg.eigh(products)
    values, turned = np.maximum(values, 0.0), vectors.T @ pulls
    noise, weight, coef = 1.0 / (square / n + np.finfo(float).eps), 1.0, np.zeros(len(pulls))
    for step in range(steps):
        old, coef = coef, vectors @ (turned / (values + weight / noise))
        left = max(square - 2.0 * float(coef @ pulls) + float(coef @ products @ coef), 0.0)
        known = float((noise * values / (weight + noise * values)).sum())
        weight, noise = (known + 2e-6) / (float(coef @ coef) + 2e-6), (n - known + 2e-6) / (left + 2e-6)
        if step and float(np.abs(old - coef).sum()) < tol:
            break
    return vectors @ (turned / (values + weight / noise))


class ChainedFill(ColumnEstimator):
    """Round-robin regression of each gappy column on the others: ``estimator`` is ``ridge`` (a slight fixed penalty) or ``bayesian``.

    A step needs only the sums of products over rows where the column is present, so the
    matrix of (columns + 1)^2 numbers is what tasks send.  Steps already fitted are
    replayed inside the task, which keeps the plan the same size in every round.
    """

    def _fit(self, df: DataFrame) -> ChainedFillModel:
        cols, rounds, tol = self.cols, self.option("rounds", 10), self.option("tol", 1e-3)
        stats = summarize(df, cols, (), moments=2)
        rows, nulls = null_counts(df.select(*[ref(c) for c in cols]))
        means = np.array([stats[c].mean if stats[c].n else 0.0 for c in cols])
        scale = np.array([(stats[c].std_pop or 1.0) or 1.0 for c in cols])
        order = sorted((c for c in cols if 0 < nulls[c] < rows), key=lambda c: (nulls[c], cols.index(c)))
        values = clean_values(df, cols)
        wide = df.select(*[values[c].alias(c) for c in cols])
        steps: list[tuple[int, np.ndarray, float]] = []
        last: dict[int, np.ndarray] = {}
        if len(cols) > 1:
            for _ in range(rounds):
                change = 0.0
                for c in order:
                    j = cols.index(c)
                    coef, intercept = self._solve(wide, cols, means, scale, steps, j, self.option("estimator", "ridge"))
                    steps.append((j, coef, intercept))
                    new = np.append(coef * scale / scale[j], intercept / scale[j])
                    change = max(change, float(np.max(np.abs(new - last[j]))) if j in last else np.inf)
                    last[j] = new
                if change < tol:
                    break
        return ChainedFillModel.of({
            "cols": cols, "means": means.tolist(),
            "steps": [{"col": j, "coef": b.tolist(), "intercept": float(a)} for j, b, a in steps]})

    @staticmethod
    def _solve(wide: DataFrame, cols, means, scale, steps, j: int, estimator: str = "ridge") -> tuple[np.ndarray, float]:
        d = len(cols)
        fixed = list(steps)

        def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((d + 1, d + 1))
            for pdf in batches:
                x, gaps = _start(pdf, cols, means)
                x = _replay(x, gaps, fixed)[~gaps[:, j]]
                z = np.hstack([(x - means) / scale, np.ones((len(x), 1))])
                total += z.T @ z
            yield pd.DataFrame({"cell": np.arange((d + 1) ** 2), "s": total.ravel()})

        sums = wide.mapInPandas(products, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
        g = np.zeros((d + 1) ** 2)
        for r in sums:
            g[r["cell"]] = r["s"]
        g = g.reshape(d + 1, d + 1)
        if estimator == "bayesian":
            others, n = [i for i in range(d) if i != j], max(g[d, d], 1.0)
            centred = (g[:d, :d] - np.outer(g[:d, d], g[:d, d]) / n) * np.outer(scale, scale)
            coef = np.zeros(d)
            coef[others] = bayesian_ridge(centred[np.ix_(others, others)], centred[others, j], float(centred[j, j]), n)
            at = means + scale * g[:d, d] / n
            return coef, float(at[j] - coef @ at)
        if estimator != "ridge":
            raise ValueError(f"unknown estimator {estimator!r}")
        use = [i for i in range(d + 1) if i != j]
        a = g[np.ix_(use, use)] + np.diag([1e-6 * g[d, d] if i != d else 0.0 for i in use])
        b = np.linalg.lstsq(a, g[use, j], rcond=None)[0]
        coef = np.zeros(d)
        for w, i in zip(b, use):
            if i != d:
                coef[i] = w * scale[j] / scale[i]
        intercept = means[j] + scale[j] * b[-1] - float(coef @ means)
        return coef, float(intercept)


def imputer(strategy: str, cols: Sequence[str]) -> ColumnEstimator:
    """Imputer by recipe key; unknown keys mean median."""
    if strategy == "knn":
        return KnnFill.of(cols, k=5)
    if strategy == "iterative":
        return ChainedFill.of(cols, estimator="bayesian")
    return Fill.of(cols, strategy=strategy if strategy in ("mean", "median", "zero") else "median")

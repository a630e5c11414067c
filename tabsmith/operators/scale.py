"""Clipping, skew correction and scaling of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import (
    as_double, clip, double_arrays, ref, with_positions, yeo_johnson,
)
from tabsmith.operators.fitted import ColumnEstimator, FittedColumns
from tabsmith.operators.order_stats import COLUMNS_PER_JOB
from tabsmith.operators.stats import clean_values, summarize

# Coefficients of Acklam's rational approximation of the normal quantile.
_PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
          -3.066479806614716e+01, 2.506628277459239e+00)
_PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
          -1.328068155288572e+01, 1.0)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
          4.374664141464968e+00, 2.938163982698783e+00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
_TAIL = 1e-7


def _horner(coefs: Sequence[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function (relative error about 1e-9), JVM-side."""
    p = F.greatest(F.least(p, F.lit(1 - _TAIL)), F.lit(_TAIL))
    q = p - 0.5
    middle = q * _horner(_PPF_A, q * q) / _horner(_PPF_B, q * q)
    left = F.sqrt(-2.0 * F.ln(p))
    right = F.sqrt(-2.0 * F.ln(1.0 - p))
    low = _horner(_PPF_C, left) / _horner(_PPF_D, left)
    high = -_horner(_PPF_C, right) / _horner(_PPF_D, right)
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(middle)


def with_normal_quantiles(df: DataFrame, wanted: Mapping[str, Column]) -> DataFrame:
    """Add ``{name: normal_quantile(p)}`` step by step, each step in its own projection.

    As one expression the steps are repeated inside each other, and a value takes about 14 times as long.
    """
    at = {name: (F.col(f"_p{i}"), F.col(f"_q{i}"), F.col(f"_r{i}"), F.col(f"_t{i}")) for i, name in enumerate(wanted)}
    clamped, middle, bent, out = {}, {}, {}, {}
    for i, (name, u) in enumerate(wanted.items()):
        p, q, r, t = at[name]
        low, high = p < 0.02425, p > 1 - 0.02425
        clamped[f"_p{i}"] = F.greatest(F.least(u, F.lit(1 - _TAIL)), F.lit(_TAIL))
        middle[f"_q{i}"] = p - 0.5
        middle[f"_t{i}"] = F.coalesce(F.sqrt(-2.0 * F.ln(F.when(low, p).when(high, 1.0 - p))), F.lit(0.0))
        bent[f"_r{i}"] = q * q
        tail = _horner(_PPF_C, t) / _horner(_PPF_D, t) * F.when(low, F.lit(1.0)).otherwise(F.lit(-1.0))
        out[name] = F.when(low | high, tail).otherwise(q * _horner(_PPF_A, r) / _horner(_PPF_B, r))
    for step in (clamped, middle, bent, out):
        df = df.withColumns(step)
    return df.drop(*clamped, *middle, *bent)


class ClipModel(FittedColumns):
    def expressions(self, df: DataFrame) -> dict[str, Column]:
        return {c: clip(as_double(c), F.lit(float(lo)), F.lit(float(hi))) for c, (lo, hi) in self.fitted.items()}


class OutlierClip(ColumnEstimator):
    """Clip to the quartiles widened by ``factor`` (default 3) interquartile ranges."""

    def _fit(self, df: DataFrame) -> ClipModel:
        factor = self.option("factor", 3.0)
        stats = summarize(df, self.cols, (0.25, 0.75), moments=0)
        bounds = {}
        for c, s in stats.items():
            if s.n:
                q1, q3 = s.quantiles[0.25], s.quantiles[0.75]
                bounds[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
        return ClipModel.of(bounds)


def _power_moments(wanted: dict[int, list[float]]):
    """Per task: count, mean and squared deviations of each transformed column, and its sum of signed logarithms."""
    def run(batches):
        state: dict[tuple[int, float], np.ndarray] = {}
        for batch in batches:
            for at, lams in wanted.items():
                x = batch.column(at).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                size, down = np.log1p(np.abs(x)), x < 0
                some_down = bool(down.any())
                jacobian = float(np.where(down, -size, size).sum())
                for lam in lams:
                    y = size if abs(lam) < 1e-12 else (np.exp(lam * size) - 1.0) / lam
                    if some_down:
                        back = 2.0 - lam
                        y = np.where(down, -size if abs(back) < 1e-12 else (1.0 - np.exp(back * size)) / back, y)
                    mean = y.mean()
                    d = y - mean
                    new = np.array([len(y), mean, (d * d).sum(), jacobian])
                    state[at, lam] = _joined(np.stack([state[at, lam], new])) if (at, lam) in state else new
        keys = list(state)
        rows = np.array([state[k] for k in keys]).reshape(-1, 4)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.float64()), *map(pa.array, rows.T)], _MOMENTS)

    def quiet(batches):
        with np.errstate(over="ignore", invalid="ignore"):  # exponents that pass the range are not usable
            yield from run(batches)
    return quiet


_MOMENTS = ["at", "lam", "n", "mean", "m2", "j"]
_MOMENT_TYPES = "at int, lam double, n double, mean double, m2 double, j double"


def _joined(parts: np.ndarray) -> np.ndarray:
    """Moments (n, mean, m2, j) of all parts together."""
    n, mean, m2, j = parts.T
    whole = (n * mean).sum() / n.sum()
    return np.array([n.sum(), whole, (m2 + n * (mean - whole) ** 2).sum(), j.sum()])


def _join_moments(table: pa.Table) -> pa.Table:
    with np.errstate(over="ignore", invalid="ignore"):
        whole = _joined(np.column_stack([table.column(c).to_numpy() for c in _MOMENTS[2:]]))
    return pa.table([table.column("at").slice(0, 1), table.column("lam").slice(0, 1), *(pa.array([v]) for v in whole)], _MOMENTS)


def _likelihoods(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], float]:
    """Log-likelihood of each wanted exponent of each column that has values; a task sends only its moments."""
    out = {}
    cols = [c for c in wanted if wanted[c]]
    for start in range(0, len(cols), COLUMNS_PER_JOB):
        chunk = cols[start:start + COLUMNS_PER_JOB]
        rows = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(chunk)])
        moments = rows.mapInArrow(_power_moments({i: list(wanted[c]) for i, c in enumerate(chunk)}), _MOMENT_TYPES)
        # A row for each column and exponent.
        for r in moments.groupBy("at", "lam").applyInArrow(_join_moments, _MOMENT_TYPES).collect():
            v = r["m2"] / r["n"]
            usable = v == v and v > 0 and not math.isinf(v)
            out[chunk[r["at"]], r["lam"]] = -r["n"] / 2.0 * math.log(v) + (r["lam"] - 1.0) * r["j"] if usable else -math.inf
    return out


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], points: int = 7, rounds: int = 5) -> dict[str, float]:
    """Maximum-likelihood exponent per column.

    Every round evaluates ``points`` exponents of every column, those of earlier rounds not
    again, then narrows around the best; a parabola through the last three finishes.
    """
    lo = dict.fromkeys(cols, -4.0)
    hi = dict.fromkeys(cols, 6.0)
    out: dict[str, float] = {}
    known: dict[tuple[str, float], float] = {}
    for _ in range(rounds):
        grids = {}
        for c in lo:
            grid = [lo[c] + i * (hi[c] - lo[c]) / (points - 1) for i in range(points)]
            # The same exponent comes again with other last digits.
            tried = [lam for name, lam in known if name == c]
            grids[c] = [next((t for t in tried if abs(t - lam) < 1e-9 * (hi[c] - lo[c])), lam) for lam in grid]
        known |= _likelihoods(df, {c: [lam for lam in grids[c] if (c, lam) not in known] for c in grids})
        for c in [c for c in grids if all((c, lam) not in known for lam in grids[c])]:
            lo.pop(c)  # a column without values
        for c in lo:
            grid = grids[c]
            fit = [known[c, lam] for lam in grid]
            best = max(range(points), key=fit.__getitem__)
            step = (hi[c] - lo[c]) / (points - 1)
            out[c] = grid[best]
            if 0 < best < points - 1 and min(fit[best - 1], fit[best + 1]) > -math.inf:
                a, b, d = fit[best - 1], fit[best], fit[best + 1]
                bend = a - 2 * b + d
                if bend < 0:
                    out[c] = grid[best] + 0.5 * step * (a - d) / bend
                lo[c], hi[c] = grid[best] - step, grid[best] + step
            elif 0 < best < points - 1:
                lo[c], hi[c] = grid[best] - step, grid[best] + step
            else:  # the optimum may lie beyond the edge
                lo[c], hi[c] = grid[best] - 2 * step, grid[best] + 2 * step
    return {c: out.get(c, 1.0) for c in cols}


class PowerModel(FittedColumns):
    """Standardised Yeo-Johnson; columns marked ``log1p`` take the logarithm instead."""

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for c, f in self.fitted.items():
            x = as_double(c)
            if f.get("log1p"):
                out[c] = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
            else:
                if f.get("null_as_zero"):
                    x = F.coalesce(x, F.lit(0.0))
                out[c] = (yeo_johnson(x, F.lit(f["lambda"])) - F.lit(f["mean"])) / F.lit(f["scale"])
        return out


def _standardised_powers(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    if not cols:
        return {}
    lambdas = fit_yeo_johnson(df, cols)
    values = clean_values(df, cols)
    stats = summarize(df, {c: yeo_johnson(values[c], F.lit(lambdas[c])) for c in cols}, (), moments=2)
    return {
        c: {"lambda": lambdas[c], "mean": s.mean if s.n else 0.0, "scale": (s.std_pop if s.n else 0.0) or 1.0}
        for c, s in stats.items()
    }


class SkewCorrect(ColumnEstimator):
    """Columns with |skew| over ``threshold`` (0.8): log1p if never negative, else Yeo-Johnson."""

    def _fit(self, df: DataFrame) -> PowerModel:
        threshold = self.option("threshold", 0.8)
        stats = summarize(df, self.cols, (), moments=3)
        skewed = [c for c, s in stats.items() if s.skew is not None and abs(s.skew) > threshold]
        spec: dict[str, dict] = {c: {"log1p": True} for c in skewed if stats[c].lo >= 0}
        rest = [c for c in skewed if c not in spec]
        filled = df.select(*[F.coalesce(as_double(c), F.lit(0.0)).alias(c) for c in rest]) if rest else df
        spec.update({c: {**f, "null_as_zero": True} for c, f in _standardised_powers(filled, rest).items()})
        return PowerModel.of(spec)


class PowerScale(ColumnEstimator):
    """Yeo-Johnson by maximum likelihood, then zero mean and unit variance."""

    def _fit(self, df: DataFrame) -> PowerModel:
        return PowerModel.of(_standardised_powers(df, self.cols))


class AffineModel(FittedColumns):
    def expressions(self, df: DataFrame) -> dict[str, Column]:
        return {c: (as_double(c) - F.lit(float(a))) / F.lit(float(b)) for c, (a, b) in self.fitted.items()}


class AffineScale(ColumnEstimator):
    """kind: standard (population std), minmax, or robust (median and IQR).  A zero width
    divides by 1, so a constant column becomes 0."""

    def _fit(self, df: DataFrame) -> AffineModel:
        kind = self.option("kind", "standard")
        probs = (0.25, 0.5, 0.75) if kind == "robust" else ()
        stats = summarize(df, self.cols, probs, moments=2 if kind == "standard" else 0)
        spec = {}
        for c, s in stats.items():
            if not s.n:
                spec[c] = (0.0, 1.0)
            elif kind == "minmax":
                spec[c] = (s.lo, (s.hi - s.lo) or 1.0)
            elif kind == "robust":
                spec[c] = (s.quantiles[0.5], (s.quantiles[0.75] - s.quantiles[0.25]) or 1.0)
            else:
                spec[c] = (s.mean, s.std_pop or 1.0)
        return AffineModel.of(spec)


class QuantileModel(FittedColumns):
    """Position between fitted quantiles (ties in the middle of their span), as a normal score."""

    def _transform(self, df: DataFrame) -> DataFrame:
        # Separate projections, so that a position is computed once per value.
        cols = {c: k for c, k in self.fitted.items() if len(k) > 1}
        flat = {c: F.when(as_double(c).isNotNull(), F.lit(0.0)) for c in self.fitted if c not in cols}
        out = df.withColumns({c: as_double(c) for c in cols})
        out = with_positions(out, {f"_at{i}": (c, knots, True) for i, (c, knots) in enumerate(cols.items())})
        found, place, score = {}, {}, {}
        for i, (c, knots) in enumerate(cols.items()):
            x, last = ref(c), len(knots) - 1
            edges = sorted(set(knots))
            # Middle of the span of knots that equal an edge, and the span's end.
            first = {e: knots.index(e) for e in edges}
            end = {e: first[e] + knots.count(e) - 1 for e in edges}
            j = F.col(f"_at{i}") - F.lit(1)
            found[f"_edge{i}"] = F.get(double_arrays(edges), j)
            found[f"_gap{i}"] = F.get(double_arrays([b - a for a, b in zip(edges, edges[1:])]), j)
            found[f"_mid{i}"] = F.get(double_arrays([(first[e] + end[e]) / 2.0 / last for e in edges]), j)
            found[f"_tail{i}"] = F.get(double_arrays([end[e] / float(last) for e in edges]), j)
            edge, gap, mid, tail = (F.col(n) for n in list(found)[-4:])
            place[f"_u{i}"] = (
                F.when(x <= F.lit(float(edges[0])), F.lit(0.0)).when(x >= F.lit(float(edges[-1])), F.lit(1.0))
                .when(x == edge, mid).otherwise(tail + (x - edge) / gap / F.lit(float(last)))
            )
            score[f"_s{i}"] = F.col(f"_u{i}")
        if cols:
            out = with_normal_quantiles(out.withColumns(found).withColumns(place), score)
        scores = {c: F.when(ref(c).isNotNull(), F.col(f"_s{i}")) for i, c in enumerate(cols)}
        if scores or flat:
            out = out.withColumns({**scores, **flat})
        return out.drop(*found, *place, *score, *[f"_at{i}" for i in range(len(cols))])


class QuantileScale(ColumnEstimator):
    """Map to a normal distribution through up to ``levels`` (1000) exact quantiles."""

    def _fit(self, df: DataFrame) -> QuantileModel:
        rough = summarize(df, self.cols, (), moments=0)
        levels = int(max(2, min(self.option("levels", 1000), max((s.n for s in rough.values()), default=2))))
        probs = [i / (levels - 1) for i in range(levels)]
        stats = summarize(df, self.cols, probs, moments=0)
        return QuantileModel.of({c: [s.quantiles[p] for p in probs] if s.n else [0.0] for c, s in stats.items()})


class RowNormModel(FittedColumns):
    def expressions(self, df: DataFrame) -> dict[str, Column]:
        cols = self.fitted
        total = F.lit(0.0)
        for c in cols:
            total = total + F.coalesce(as_double(c) * as_double(c), F.lit(0.0))
        norm = F.sqrt(total)
        return {c: as_double(c) / F.when(norm == 0, F.lit(1.0)).otherwise(norm) for c in cols}


class RowNormalize(ColumnEstimator):
    """Divide the columns of each row by the row's euclidean length."""

    def _fit(self, df: DataFrame) -> RowNormModel:
        return RowNormModel.of(self.cols)


def scaler(kind: str, cols: Sequence[str]) -> ColumnEstimator:
    """Scaler by recipe key; unknown keys mean standard."""
    if kind == "power":
        return PowerScale.of(cols)
    if kind == "quantile":
        return QuantileScale.of(cols)
    if kind == "normalize":
        return RowNormalize.of(cols)
    return AffineScale.of(cols, kind=kind if kind in ("standard", "minmax", "robust") else "standard")

"""Shapiro-Wilk on a bounded sample, Shapiro-Francia on all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import row_key
from tabsmith.functions.session import cut_lineage
from tabsmith.operators.order_stats import running_totals
from tabsmith.operators.scale import with_normal_quantiles
from tabsmith.operators.stats import clean_values, report, summarize

# Polynomials of Royston's approximation (AS R94), lowest power first.
FIRST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN, SMALL_SPREAD = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _polynomial(c: Sequence[float], x: float) -> float:
    return sum(a * x**i for i, a in enumerate(c))


def shapiro_weights(n: int) -> np.ndarray:
    """Weights of the order statistics, antisymmetric, of unit length."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square, root = float(m @ m), 1.0 / math.sqrt(n)
    out = m.copy()
    last = m[-1] / math.sqrt(square) + _polynomial(FIRST_WEIGHT, root)
    if n > 5:
        second = m[-2] / math.sqrt(square) + _polynomial(SECOND_WEIGHT, root)
        out /= math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        out[1], out[-2] = -second, second
    else:
        out /= math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    out[0], out[-1] = -last, last
    return out


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """(W, p) of 3 to 5,000 values; of equal values (1, 1)."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000:
        raise ValueError("Shapiro-Wilk takes 3 to 5,000 values")
    spread = float(((x - x.mean()) ** 2).sum())
    if spread <= 0:
        return 1.0, 1.0
    w = min(1.0, float(shapiro_weights(n) @ x) ** 2 / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1.0:
        return 1.0, 1.0
    y, size = math.log(1.0 - w), math.log(n)
    if n <= 11:
        gamma = _polynomial(SMALL_GAMMA, n)
        if y >= gamma:
            return w, 0.0
        y, mean, scale = -math.log(gamma - y), _polynomial(SMALL_MEAN, n), math.exp(_polynomial(SMALL_SPREAD, n))
    else:
        mean, scale = _polynomial(LARGE_MEAN, size), math.exp(_polynomial(LARGE_SPREAD, size))
    return w, 0.5 * math.erfc((y - mean) / scale / math.sqrt(2.0))


def shapiro_table(df: DataFrame, cols: Sequence[str], sample: int = 500, least: int = 8) -> DataFrame:
    """``(column, n, w, p, normal)`` of a sample of ``sample`` values of each column; columns with fewer than ``least`` values have no row.

    The sample is that of the values with the smallest row hashes, the same on every run; normal means p over 0.05.
    """
    if not 3 <= least <= sample <= 5000:
        raise ValueError("the sample must have 3 to 5,000 values")
    values, rows = clean_values(df, cols), []
    key = row_key(df.columns, 42)
    for c in cols:
        x = [r[0] for r in df.where(values[c].isNotNull()).orderBy(key, values[c]).limit(sample).select(values[c].alias("v")).collect()]
        if len(x) >= least:
            w, p = shapiro_wilk(x)
            rows.append((c, len(x), w, p, p > 0.05))
    return report(df.sparkSession, rows, "column string, n int, w double, p double, normal boolean")


def shapiro_francia(df: DataFrame, cols: Sequence[str], bucket_rows: int | None = None) -> DataFrame:
    """``(column, n, w)``: squared correlation of all ordered values with normal scores at (rank - 0.375) / (n + 0.25).

    Ranks come from prefix sums over distinct values; a value that stands often has the scores of all its ranks.
    Columns with fewer than three values or a single distinct one have no row.
    """
    stats, values = summarize(df, cols, (), moments=2), clean_values(df, cols)
    used = [c for c in cols if stats[c].n >= 3 and stats[c].m2 > 0]
    spark = df.sparkSession
    if not used:
        return report(spark, [], "column string, n long, w double")
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), values[c].cast("double").alias("v")) for c in used)))).where("v is not null")
    counts = cut_lineage(long.groupBy("column", "v").agg(F.count("*").alias("k")))
    more = {} if bucket_rows is None else {"bucket_rows": bucket_rows}
    ranked = running_totals(counts, ["column"], "v", ["k"], counts.count(), **more)
    facts = spark.createDataFrame([(c, stats[c].n, float(stats[c].mean), float(stats[c].m2)) for c in used], "column string, n long, mean double, m2 double")
    each = ranked.join(F.broadcast(facts), "column").select(  # a row for each column
        "column", "n", "m2", (F.col("v") - F.col("mean")).alias("d"), F.explode(F.sequence(F.col("cum_k") - F.col("k") + 1, F.col("cum_k"))).alias("rank"))
    scored = with_normal_quantiles(each, {"m": (F.col("rank") - 0.375) / (F.col("n") + 0.25)})
    found = scored.groupBy("column", "n", "m2").agg(F.sum(F.col("m") * F.col("d")).alias("both"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    return found.select("column", "n", (F.col("both") * F.col("both") / (F.col("mm") * F.col("m2"))).alias("w"))

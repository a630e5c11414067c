"""Per-column numeric summaries shared by the report sections, scalers and imputers.

Moments take two plain passes (count/sum/min/max, then central power sums around the
exact mean).  Simple sums stay inside whole-stage codegen, which is several times
faster than the built-in higher-moment aggregates, and centring first keeps precision.
Columns are handled in chunks; a chunk scans only its own columns.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import as_double, power, ref
from tabsmith.operators.order_stats import COLUMNS_PER_JOB, column_quantiles

QUARTILES = (0.25, 0.5, 0.75)


@dataclass
class ColumnSummary:
    n: int = 0
    mean: float | None = None
    lo: float | None = None
    hi: float | None = None
    m2: float = 0.0  # central power sums
    m3: float = 0.0
    m4: float = 0.0
    quantiles: dict[float, float] = field(default_factory=dict)

    @property
    def std(self) -> float | None:
        return math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else None

    @property
    def std_pop(self) -> float | None:
        return math.sqrt(self.m2 / self.n) if self.n else None

    @property
    def skew(self) -> float | None:
        n = self.n
        if n < 3 or self.m2 <= 0:
            return None
        g1 = math.sqrt(n) * self.m3 / self.m2 ** 1.5
        return g1 * math.sqrt(n * (n - 1)) / (n - 2)

    @property
    def kurtosis(self) -> float | None:
        n = self.n
        if n < 4 or self.m2 <= 0:
            return None
        g2 = n * self.m4 / self.m2 ** 2 - 3.0
        return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6.0)


def clean_values(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Double expressions of the columns, NaN read as NULL."""
    types = {f.name: f.dataType for f in df.schema}
    out = {}
    for c in cols:
        v = as_double(c)
        if isinstance(types[c], (T.FloatType, T.DoubleType)):
            v = F.nanvl(v, F.lit(None).cast("double"))
        out[c] = v
    return out


def summarize(
    df: DataFrame,
    cols: Sequence[str] | Mapping[str, Column],
    probs: Sequence[float] = QUARTILES,
    moments: int = 4,
) -> dict[str, ColumnSummary]:
    """Count, range, central moments up to ``moments`` and exact quantiles per column.

    ``cols`` are names, or named expressions of type double.
    """
    values = dict(cols) if isinstance(cols, Mapping) else clean_values(df, cols)
    names = list(values)
    out: dict[str, ColumnSummary] = {}
    for start in range(0, len(names), COLUMNS_PER_JOB):
        chunk = names[start:start + COLUMNS_PER_JOB]
        aggs = []
        for i, c in enumerate(chunk):
            v = values[c]
            aggs += [F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"),
                     F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        r = df.agg(*aggs).first()
        for i, c in enumerate(chunk):
            n = r[f"n{i}"]
            out[c] = ColumnSummary(n, r[f"s{i}"] / n if n else None, r[f"lo{i}"], r[f"hi{i}"])
        live = [(i, c) for i, c in enumerate(chunk) if out[c].n]
        if moments >= 2 and live:
            aggs = []
            for i, c in live:
                d = values[c] - F.lit(out[c].mean)
                aggs += [F.sum(power(d, k)).alias(f"m{k}_{i}") for k in range(2, moments + 1)]
            r = df.agg(*aggs).first()
            for i, c in live:
                s = out[c]
                constant = s.lo == s.hi
                for k in range(2, moments + 1):
                    setattr(s, f"m{k}", 0.0 if constant else r[f"m{k}_{i}"])
    if probs:
        have = [c for c in names if out[c].n]
        quantiles = column_quantiles(
            df, {c: values[c] for c in have}, {c: out[c].n for c in have},
            {c: (out[c].lo, out[c].hi) for c in have}, probs,
        )
        for c in have:
            out[c].quantiles = quantiles[c]
    return out


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> dict[str, int]:
    """``count_if`` of many conditions, in chunks of one aggregate each."""
    names = list(conditions)
    out = {}
    for start in range(0, len(names), 2 * COLUMNS_PER_JOB):
        chunk = names[start:start + 2 * COLUMNS_PER_JOB]
        r = df.agg(*[F.count_if(conditions[c]).alias(f"c{i}") for i, c in enumerate(chunk)]).first()
        out.update({c: r[i] for i, c in enumerate(chunk)})
    return out


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and NULL-or-NaN count of every column."""
    fields = df.schema.fields
    present: dict[str, int] = {}
    rows = 0
    for start in range(0, max(1, len(fields)), 100):
        chunk = fields[start:start + 100]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(chunk):
            v = ref(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                v = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
            aggs.append(F.count(v).alias(f"c{i}"))
        r = df.agg(*aggs).first()
        rows = r["rows"]
        present.update({f.name: r[f"c{i}"] for i, f in enumerate(chunk)})
    return rows, {c: rows - n for c, n in present.items()}


def report(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A report section: one row per column or finding, so bounded by the schema."""
    return spark.createDataFrame(list(rows), schema)


def round_doubles(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    return df.select(*[
        F.round(ref(f.name), special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else ref(f.name)
        for f in df.schema
    ])

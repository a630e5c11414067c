"""Column expressions shared by the operators.  All of them stay JVM-side."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def ref(name: str) -> Column:
    """Reference a column by its exact name, even with dots or spaces in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def date_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, DATE_TYPES) and f.name not in exclude]


def boolean_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType) and f.name not in exclude]


def as_double(name: str) -> Column:
    return ref(name).cast("double")


def power(x: Column, k: int) -> Column:
    """Integer power by multiplication; much cheaper than ``pow`` inside codegen."""
    out = x
    for _ in range(k - 1):
        out = out * x
    return out


def divide(a: Column, b: Column) -> Column:
    """NULL instead of an ANSI error on division by zero."""
    return F.try_divide(a, b)


FEW_EDGES = 4


def count_edges(value: Column, edges: Sequence[float], inclusive: bool = True) -> Column:
    """Number of ``edges`` that are <= value (or < value), as a codegen sum of comparisons."""
    out = F.lit(0)
    for e in edges:
        out = out + (value >= F.lit(float(e)) if inclusive else value > F.lit(float(e))).cast("int")
    return out


def with_positions(df: DataFrame, wanted: dict[str, tuple[str, Sequence[float], bool]]) -> DataFrame:
    """Add ``{name: (column, edges, inclusive)}``: how many sorted edges are <= (or <) the value.

    Many edges go through ``Bucketizer``, a binary search on the JVM; NULL stays NULL.
    """
    few, many, negated = {}, {}, {}
    for name, (c, edges, inclusive) in wanted.items():
        edges = sorted({float(e) for e in edges})
        if len(edges) <= FEW_EDGES:
            few[name] = count_edges(ref(c), edges, inclusive)
        elif inclusive:
            many[name] = (c, edges)
        else:
            # edges < v  is  all edges minus those with -edge <= -v
            negated[f"_neg_{name}"] = -ref(c)
            many[name] = (f"_neg_{name}", [-e for e in reversed(edges)])
    out = df.withColumns({**few, **negated}) if few or negated else df
    if many:
        out = Bucketizer(
            inputCols=[c for c, _ in many.values()], outputCols=list(many), handleInvalid="keep",
            splitsArray=[[-math.inf, *edges, math.inf] for _, edges in many.values()],
        ).transform(out)
        out = out.withColumns({
            n: (F.lit(len(e)) - F.col(n) if c.startswith("_neg_") else F.col(n)).cast("int") for n, (c, e) in many.items()})
    return out.drop(*negated)


def double_arrays(values) -> Column:
    """Constant array (or array of arrays) of doubles, folded once by the optimizer."""
    nested = bool(values) and isinstance(values[0], (list, tuple))
    return F.from_json(F.lit(json.dumps(values)), "array<array<double>>" if nested else "array<double>")


def search_sorted_array(value: Column, edges: Column, max_len: int, inclusive: bool = True) -> Column:
    """``search_sorted`` against an array column of at most ``max_len`` edges."""
    steps = [1 << i for i in reversed(range(max(1, int(max_len).bit_length())))]

    def step(pos: Column, s: Column) -> Column:
        edge = F.get(edges, pos + s - F.lit(1))
        hit = (edge <= value) if inclusive else (edge < value)
        return F.when(hit, pos + s).otherwise(pos)

    return F.reduce(F.lit(steps), F.lit(0), step)


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Zero-based bin of ``bins`` equal-width bins on [lo, hi], last bin closed.

    A constant column is widened by 0.5 on each side.
    """
    lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
    hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
    raw = F.floor(divide(value - lo2, (hi2 - lo2) / float(bins)))
    return F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")


def sample_skew(n: Column, m2: Column, m3: Column) -> Column:
    """Bias-corrected skewness from central sums; NULL below 3 rows or for a constant."""
    g1 = divide(F.sqrt(n) * m3, m2 * F.sqrt(m2))
    return F.when((n > 2) & (m2 > 0), g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def sample_kurtosis(n: Column, m2: Column, m4: Column) -> Column:
    """Bias-corrected excess kurtosis from central sums; NULL below 4 rows or for a constant."""
    g2 = divide(n * m4, m2 * m2) - 3.0
    scale = divide(n - 1, (n - 2) * (n - 3))
    return F.when((n > 3) & (m2 > 0), scale * ((n + 1) * g2 + 6.0))


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """128-bit row fingerprint as two longs.

    Spark's hashes skip NULLs, so each value is hashed with its null flag; without
    it (NULL, 5) and (5, NULL) would collide.
    """
    parts: list[Column] = []
    for name in columns:
        parts += [ref(name).isNull(), ref(name)]
    return [F.xxhash64(F.lit(17), *parts).alias("_fp1"), F.xxhash64(F.lit(40503), *reversed(parts)).alias("_fp2")]


def row_key(columns: Sequence[str], seed: int = 42) -> Column:
    """Repeatable pseudo-random long for a row, never based on row order."""
    parts: list[Column] = []
    for name in columns:
        parts += [ref(name).isNull(), ref(name)]
    return F.xxhash64(F.lit(seed), *parts)


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson power transform of ``x`` with exponent ``lam``."""
    near0 = F.abs(lam) < 1e-12
    near2 = F.abs(lam - 2.0) < 1e-12
    pos = F.when(near0, F.log1p(x)).otherwise(divide(F.pow(x + 1.0, lam) - 1.0, lam))
    neg = F.when(near2, -F.log1p(-x)).otherwise(-divide(F.pow(1.0 - x, 2.0 - lam) - 1.0, 2.0 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """Clip that keeps NULL as NULL (``least``/``greatest`` skip NULLs)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def unpivot_numeric(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep..., column, value double)`` without NULL or NaN values."""
    wide = df.select(*[ref(k) for k in keep], *[as_double(c).alias(c) for c in cols])
    ids = [ref(k) for k in keep]
    long = wide.unpivot(ids, [ref(c) for c in cols], "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def unpivot_strings(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep..., column, value string)``; NULLs are kept."""
    wide = df.select(*[ref(k) for k in keep], *[ref(c).cast("string").alias(c) for c in cols])
    return wide.unpivot([ref(k) for k in keep], [ref(c) for c in cols], "column", "value")

"""Row-wise feature engineering, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import DATE_TYPES, as_double, divide, numeric_columns, ref
from tabsmith.operators.roles import parse_timestamp
from tabsmith.operators.stats import clean_values

DATE_PARTS = ("year", "month", "day", "weekday", "hour", "is_wknd")


def date_part_columns(df: DataFrame, name: str) -> list[Column]:
    """year, month, day, weekday (Monday 0), hour and weekend flag; 0 where there is no date."""
    kind = df.schema[name].dataType
    ts = ref(name).cast("timestamp") if isinstance(kind, DATE_TYPES) else parse_timestamp(ref(name).cast("string"))
    parts = {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts),
        "hour": F.hour(ts), "is_wknd": (F.weekday(ts) >= 5).cast("int"),
    }
    return [F.coalesce(e, F.lit(0)).cast("int").alias(f"{name}_{p}") for p, e in parts.items()]


def date_parts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace date columns by their parts."""
    keep = [ref(c) for c in df.columns if c not in names]
    return df.select(*keep, *[c for n in names for c in date_part_columns(df, n)])


def _pair_columns(df: DataFrame, cols: Sequence[str], mark: str, make) -> dict[str, Column]:
    out = {}
    for a, b in combinations(cols[:4], 2):
        name = f"{a}_{mark}_{b}"
        if name not in df.columns:
            out[name] = make(as_double(a), as_double(b))
    return out


def _row_aggregates(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Mean, sample std, max and min over the row's non-null values.

    Plain sums instead of array functions: they stay in generated code.
    """
    values = list(clean_values(df, cols).values())
    zero, n, total = F.lit(0.0), F.lit(0), F.lit(0.0)
    for v in values:
        n = n + v.isNotNull().cast("int")
        total = total + F.coalesce(v, zero)
    top, bottom = (F.greatest(*values), F.least(*values)) if len(values) > 1 else (values[0], values[0])
    out = df.withColumns({"_n": n, "_feat_mean": divide(total, n), "_feat_max": top, "_feat_min": bottom})
    squares = zero
    for v in values:
        d = v - F.col("_feat_mean")
        squares = squares + F.coalesce(d * d, zero)
    out = out.withColumn("_feat_std", F.when(F.col("_n") > 1, F.sqrt(squares / F.nullif(F.col("_n") - 1, F.lit(0))))).drop("_n")
    return out, ["_feat_mean", "_feat_std", "_feat_max", "_feat_min"]


def _log_columns(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    cols = [c for c in cols[:6] if f"{c}_log" not in df.columns]
    if not cols:
        return {}
    # A gap makes a column not strictly positive.
    r = df.agg(*[
        F.bool_and(F.coalesce(as_double(c) > 0, F.lit(False))).alias(f"p{i}") for i, c in enumerate(cols)
    ]).first()
    return {f"{c}_log": F.log1p(as_double(c)) for i, c in enumerate(cols) if r[i]}


STRATEGIES = ("interactions", "ratios", "polynomial", "aggregates", "log_transform")


def engineer_features(df: DataFrame, target: str | None, strategy: str,
                      top: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Add one family of features; existing names are skipped.  Returns the new names too.

    ``interactions`` and ``ratios`` pair the first four numeric features, ``polynomial``
    squares five, ``aggregates`` summarises ten per row, ``log_transform`` takes log1p of
    the strictly positive among six.  ``top`` restricts and orders the features.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    cols = numeric_columns(df, [target] if target else [])
    if top:
        cols = [c for c in top if c in cols] or cols
    if strategy == "interactions":
        new = _pair_columns(df, cols, "x", lambda a, b: a * b)
    elif strategy == "ratios":
        new = _pair_columns(df, cols, "div", lambda a, b: divide(a, F.nullif(b, F.lit(0.0)) + 1e-8))
    elif strategy == "polynomial":
        new = {f"{c}_sq": as_double(c) * as_double(c) for c in cols[:5] if f"{c}_sq" not in df.columns}
    elif strategy == "aggregates":
        return _row_aggregates(df, cols[:10]) if cols else (df, [])
    else:
        new = _log_columns(df, cols)
    return df.withColumns(new) if new else df, list(new)

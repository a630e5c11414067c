"""Column roles: identifiers, numeric, low/high-cardinality strings, dates; problem type."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import (
    boolean_columns, date_columns, numeric_columns, ref, string_columns, unpivot_strings,
)

# Column names that mark identifiers or personal data.
ID_NAMES = re.compile(
    r"(id|idx|index|row_?num|row_?id|uuid|guid|key|pk|serial|record_?id|"
    r"name|full_?name|first_?name|last_?name|surname|fname|lname|"
    r"email|phone|address|url|link|ip|ssn|passport|license|"
    r"timestamp|created_?at|updated_?at|date_?time)",
    re.IGNORECASE,
)
LOW_CARDINALITY = 50
MAX_CLASSES = 20
# Formats tried after ISO for dates kept as strings.
DATE_FORMATS = ("MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy", "yyyy/MM/dd", "MMM d, yyyy", "d MMM yyyy")


def parse_timestamp(value: Column) -> Column:
    """Timestamp of a date string in ISO or one of ``DATE_FORMATS``; NULL if none fits."""
    short = F.when(F.length(value) <= 40, F.trim(value))
    return F.coalesce(F.try_to_timestamp(short), *[F.try_to_timestamp(short, F.lit(f)) for f in DATE_FORMATS])


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, int]:
    """Distinct non-null values per column.

    Exact counts go through one (column, value) aggregate in long form, so a repeated
    value is combined before the shuffle and no buffer holds a whole column.
    """
    cols = list(cols)
    if not cols:
        return {}
    if approx:
        r = df.agg(*[F.approx_count_distinct(ref(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return {c: r[i] for i, c in enumerate(cols)}
    long = unpivot_strings(df, cols).where("value is not null")
    found = {
        r["column"]: r["n"]
        for r in long.groupBy("column", "value").count().groupBy("column").agg(F.count("*").alias("n")).collect()
    }
    return {c: found.get(c, 0) for c in cols}


def screened_distinct_counts(df: DataFrame, counts: dict[str, int], cols: Sequence[str], near: int,
                             unique_share: float | None = None) -> dict[str, int]:
    """Distinct counts that are exact wherever a decision could depend on them.

    A sketch pass comes first.  Exact counting then runs only for columns whose sketch is
    not far above ``near`` (their groups are few) or not far below ``unique_share`` of the
    rows; for the others the sketch already settles the comparison.
    """
    rough = distinct_counts(df, cols, approx=True)
    need = [
        c for c in cols
        if rough[c] <= 10 * near or (unique_share is not None and rough[c] >= 0.6 * unique_share * counts[c])
    ]
    return {**rough, **distinct_counts(df, need)}


def _present(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    if not cols:
        return {}
    r = df.agg(*[F.count(ref(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return {c: r[i] for i, c in enumerate(cols)}


def detect_id_columns(df: DataFrame, target: str | None = None) -> list[tuple[str, str]]:
    """``(column, reason)`` for identifier-like columns, in column order.

    Reasons: ``name`` (telling name), ``near_unique`` (string, more than 95 % distinct),
    ``dense_key`` (whole numbers 0..n-1 or 1..n, whatever their order).
    """
    reasons: dict[str, str] = {}
    for c in df.columns:
        if c != target and ID_NAMES.fullmatch(c.strip()):
            reasons[c] = "name"
    rest = [c for c in df.columns if c != target and c not in reasons]
    strings = [c for c in string_columns(df) if c in rest]
    whole = [f.name for f in df.schema if f.name in rest
             and isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    counts = _present(df, strings)
    strings = [c for c in strings if counts[c] > 10]
    distinct = screened_distinct_counts(df, counts, strings, near=0, unique_share=0.95)
    for c in strings:
        if distinct[c] / counts[c] > 0.95:
            reasons[c] = "near_unique"
    if whole:
        aggs = []
        for i, c in enumerate(whole):
            aggs += [F.count(ref(c)).alias(f"n{i}"), F.min(ref(c)).alias(f"lo{i}"), F.max(ref(c)).alias(f"hi{i}")]
        r = df.agg(*aggs).first()
        # Only columns whose range fits their count exactly can be dense keys.
        candidates = {
            c: r[f"n{i}"] for i, c in enumerate(whole)
            if r[f"n{i}"] > 5 and r[f"lo{i}"] in (0, 1) and r[f"hi{i}"] - r[f"lo{i}"] + 1 == r[f"n{i}"]
        }
        exact = distinct_counts(df, list(candidates))
        for c, n in candidates.items():
            if exact[c] == n:
                reasons[c] = "dense_key"
    return [(c, reasons[c]) for c in df.columns if c in reasons]


@dataclass
class ColumnRoles:
    numeric: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    low_card: list[str] = field(default_factory=list)
    high_card: list[str] = field(default_factory=list)
    date: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.numeric + self.boolean + self.low_card + self.high_card + self.date


def split_columns(df: DataFrame, target: str | None, drop: Sequence[str] = ()) -> ColumnRoles:
    """Role of every feature column.  A string column is a date when over 80 % of it parses."""
    skip = {*drop, *([target] if target else [])}
    strings = string_columns(df, skip)
    roles = ColumnRoles(numeric_columns(df, skip), boolean_columns(df, skip), dropped=list(drop))
    text_dates: list[str] = []
    if strings:
        # Several formats are tried, so each text once: its rows are counted first.
        texts = unpivot_strings(df, strings).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
        parsed = F.when(parse_timestamp(F.col("value")).isNotNull(), F.col("n")).otherwise(0)
        shares = texts.groupBy("column").agg((F.sum(parsed) / F.sum("n")).alias("share")).collect()
        text_dates = [c for c in strings if any(r["column"] == c and r["share"] > 0.8 for r in shares)]
    cats = [c for c in strings if c not in text_dates]
    distinct = screened_distinct_counts(df, {}, cats, near=LOW_CARDINALITY)
    roles.low_card = [c for c in cats if distinct[c] <= LOW_CARDINALITY]
    roles.high_card = [c for c in cats if distinct[c] > LOW_CARDINALITY]
    native = date_columns(df, skip)
    roles.date = [c for c in df.columns if c in native or c in text_dates]
    return roles


def roles_table(df: DataFrame, target: str | None) -> DataFrame:
    """``(column, role)``; identifier columns get role ``id``, the target ``target``."""
    ids = [c for c, _ in detect_id_columns(df, target)]
    roles = split_columns(df, target, ids)
    by_name = {c: "id" for c in ids}
    for role in ("numeric", "boolean", "low_card", "high_card", "date"):
        by_name.update({c: role for c in getattr(roles, role)})
    if target:
        by_name[target] = "target"
    rows = [(c, by_name.get(c, "other")) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, role string")


def detect_problem_type(df: DataFrame, target: str, datetime_col: str | None = None) -> str:
    """``time_series``, ``classification`` or ``regression``.

    Whether there are more than 20 distinct values is settled by a sketch and, only if
    that is close, by an exact count of few groups.
    """
    if datetime_col and datetime_col in df.columns:
        return "time_series"
    kind = df.schema[target].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return "classification"
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                             T.FloatType, T.DoubleType, T.DecimalType)):
        return "classification"
    rough = distinct_counts(df, [target], approx=True)[target]
    if rough > 10 * MAX_CLASSES:
        return "regression"
    exact = distinct_counts(df, [target])[target]
    return "classification" if exact <= MAX_CLASSES else "regression"


def drop_all_unique_strings(df: DataFrame, target: str) -> list[str]:
    """String columns in which every row has its own value (NULL rows break uniqueness)."""
    cols = string_columns(df, [target])
    if not cols:
        return []
    rows = df.count()
    counts = _present(df, cols)
    full = [c for c in cols if counts[c] == rows]
    distinct = screened_distinct_counts(df, counts, full, near=0, unique_share=1.0)
    return [c for c in full if distinct[c] == rows]

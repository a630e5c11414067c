"""Pearson and Spearman correlation as long tables ``(f1, f2, r)``."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import divide, ref, unpivot_numeric
from tabsmith.functions.session import BUCKET_ROWS
from tabsmith.operators.order_stats import running_totals
from tabsmith.operators.stats import clean_values, null_counts

SCHEMA = "f1 string, f2 string, r double"


def _dense_pairs(df: DataFrame, cols: Sequence[str], pairs) -> DataFrame:
    """Null-free columns: one distributed Gram matrix, c x c numbers on the driver."""
    values = clean_values(df, cols)
    wide = df.select(*[values[c].alias(f"x{i}") for i, c in enumerate(cols)])
    vec = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="v").transform(wide)
    m = Correlation.corr(vec.select("v"), "v").first()[0].toArray()
    at = {c: i for i, c in enumerate(cols)}
    rows = []
    for a, b in pairs:
        r = float(m[at[a], at[b]])
        rows.append((a, b, None if r != r else r))
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _complete_pairs(df: DataFrame, pairs) -> DataFrame:
    """Pairs with gaps: rows where both are present, one aggregate keyed by pair.

    The shuffle carries only the partial aggregates, one per pair and task.
    """
    values = clean_values(df, sorted({c for p in pairs for c in p}))
    structs = [
        F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), values[a].alias("x"), values[b].alias("y"))
        for a, b in pairs
    ]
    long = df.select(F.inline(F.array(*structs))).where("x is not null and y is not null")
    rs = long.groupBy("f1", "f2").agg(
        divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("r"))
    # A pair that is never complete keeps its row, with NULL.
    return df.sparkSession.createDataFrame(pairs, "f1 string, f2 string").join(rs, ["f1", "f2"], "left")


def pearson_pairs(df: DataFrame, cols: Sequence[str], pairs=None, nulls: dict[str, int] | None = None) -> DataFrame:
    """Pairwise-complete Pearson r for column pairs f1 < f2 in column order."""
    pairs = list(pairs if pairs is not None else combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], SCHEMA)
    used = [c for c in cols if any(c in p for p in pairs)]
    nulls = nulls if nulls is not None else null_counts(df.select(*[ref(c) for c in used]))[1]
    dense = [p for p in pairs if not nulls[p[0]] and not nulls[p[1]]]
    gaps = [p for p in pairs if nulls[p[0]] or nulls[p[1]]]
    parts = []
    if dense:
        parts.append(_dense_pairs(df, [c for c in used if any(c in p for p in dense)], dense))
    if gaps:
        parts.append(_complete_pairs(df, gaps))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def average_ranks(df: DataFrame, cols: Sequence[str], key: Sequence[str], rows: int,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(key..., column, rank)`` with ties sharing their average rank.

    Values are first reduced to distinct (column, value) counts, so a value that holds
    a third of the rows is one row in the ranking; the join back to the rows is an
    equi-join that adaptive execution may broadcast or split when it is skewed.
    """
    long = unpivot_numeric(df, cols, key)
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = running_totals(counts, ["column"], "value", ["n"], rows, bucket_rows)
    ranks = ranked.select("column", "value", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    return long.join(ranks, ["column", "value"]).select(*[ref(k) for k in key], "column", "rank")


def spearman_pairs(df: DataFrame, cols: Sequence[str], key: Sequence[str], pairs=None,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spearman correlation; ``key`` identifies a row.

    Columns without gaps are ranked once.  A pair with gaps is ranked again on the rows
    where both values are present, as pairwise-complete correlation requires.
    """
    pairs = list(pairs if pairs is not None else combinations(cols, 2))
    rows, nulls = null_counts(df.select(*[ref(c) for c in cols]))
    # The key gets names of its own, so that a key column may also be ranked.
    df = df.select(*[ref(k).alias(f"_key{i}") for i, k in enumerate(key)], *[ref(c) for c in cols])
    key = [f"_key{i}" for i in range(len(key))]
    dense = [p for p in pairs if not nulls[p[0]] and not nulls[p[1]]]
    gaps = [p for p in pairs if nulls[p[0]] or nulls[p[1]]]
    parts = []

    def correlate(frame: DataFrame, columns: list[str], wanted) -> DataFrame:
        ranks = average_ranks(frame, columns, key, rows, bucket_rows)
        wide = ranks.groupBy(*[ref(k) for k in key]).agg(*[
            F.max(F.when(F.col("column") == c, F.col("rank"))).alias(c) for c in columns
        ])
        return pearson_pairs(wide, columns, wanted, dict.fromkeys(columns, 0))

    if dense:
        columns = [c for c in cols if any(c in p for p in dense)]
        parts.append(correlate(df, columns, dense))
    for a, b in gaps:
        values = clean_values(df, [a, b])
        both = df.where(values[a].isNotNull() & values[b].isNotNull())
        parts.append(correlate(both, [a, b], [(a, b)]))
    if not parts:
        return df.sparkSession.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_correlations(pairs: DataFrame, k: int = 15) -> DataFrame:
    """The k pairs with the largest |r|."""
    return pairs.where("r is not null").orderBy(F.abs("r").desc(), "f1", "f2").limit(k)


def target_correlations(pairs: DataFrame, target: str, k: int | None = 15) -> DataFrame:
    """|r| of each feature with the target, largest first."""
    mine = pairs.where(((F.col("f1") == target) | (F.col("f2") == target)) & F.col("r").isNotNull())
    out = mine.select(
        F.when(F.col("f1") == target, F.col("f2")).otherwise(F.col("f1")).alias("feature"),
        F.abs("r").alias("abs_r"),
    ).orderBy(F.desc("abs_r"), "feature")
    return out if k is None else out.limit(k)


def multicollinear(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    return pairs.where(F.abs("r") > threshold)

"""Drift between a reference and a current table: KS, PSI and chi-square per column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import (
    boolean_columns, date_columns, divide, equal_width_bin, numeric_columns, ref, unpivot_numeric, unpivot_strings,
)
from tabsmith.functions.session import BUCKET_ROWS
from tabsmith.functions.special import chi2_sf, kolmogorov_p
from tabsmith.operators.order_stats import running_totals

KS_THRESHOLD = 0.1
PSI_THRESHOLD = 0.2
CHI2_ALPHA = 0.05
PSI_FLOOR = 1e-4
MIN_KS_ROWS = 5

SCHEMA = ("check_ts timestamp, column string, type string, n_ref long, n_cur long, ks double, ks_p double, "
          "psi double, chi2 double, chi2_p double, drifted boolean")


def shared_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns of both tables, in reference order."""
    return [c for c in reference.columns if c in set(current.columns)]


def _both(reference: DataFrame, current: DataFrame, cols: Sequence[str], unpivot) -> DataFrame:
    a = unpivot(reference, cols).withColumn("side", F.lit(0))
    return a.unionByName(unpivot(current, cols).withColumn("side", F.lit(1)))


def _side_counts(long: DataFrame, *keys: str) -> DataFrame:
    return long.groupBy("column", *keys).agg(
        F.sum((F.col("side") == 0).cast("long")).alias("r"), F.sum((F.col("side") == 1).cast("long")).alias("c"))


def ks_statistics(reference: DataFrame, current: DataFrame, cols: Sequence[str], rows: int,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(column, n_ref, n_cur, ks)``: largest distance of the two empirical distributions.

    All columns go through one job on distinct (column, value) counts; ``rows`` is an
    upper bound of distinct values per column.
    """
    counts = _side_counts(_both(reference, current, cols, unpivot_numeric), "value")
    totals = counts.groupBy("column").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    running = running_totals(counts, ["column"], "value", ["r", "c"], rows, bucket_rows)
    gap = F.abs(divide(F.col("cum_r"), F.col("n_ref")) - divide(F.col("cum_c"), F.col("n_cur")))
    # ``totals`` has one row per column of the schema.
    return running.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def psi_from_counts(binned: DataFrame, bins: int, *keys: str) -> DataFrame:
    """``(keys..., column, psi)`` from ``(keys..., column, bin, r, c)`` counts.

    A share of zero counts as ``PSI_FLOOR``; bins empty on both sides add nothing.
    """
    group = [*keys, "column"]
    totals = binned.groupBy(*group).agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    p = F.when(F.col("r") == 0, F.lit(PSI_FLOOR)).otherwise(divide(F.col("r"), F.col("n_ref")))
    q = F.when(F.col("c") == 0, F.lit(PSI_FLOOR)).otherwise(divide(F.col("c"), F.col("n_cur")))
    return binned.join(totals, group).groupBy(*group).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def psi_statistics(reference: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """``(column, psi)`` over equal-width bins on the joint range."""
    long = _both(reference, current, cols, unpivot_numeric)
    bounds = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = long.join(F.broadcast(bounds), "column").withColumn(  # one row per column
        "bin", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    return psi_from_counts(_side_counts(binned, "bin"), bins)


def chi2_statistics(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, n_ref, n_cur, categories, chi2)`` of current against scaled reference counts.

    ``chi2`` is NULL when a category is absent from the reference (infinite statistic).
    """
    long = _both(reference, current, cols, unpivot_strings).where("value is not null")
    counts = _side_counts(long, "value")
    totals = counts.groupBy("column").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    expected = F.col("r") * F.col("n_cur") / F.col("n_ref")
    term = divide((F.col("c") - expected) * (F.col("c") - expected), expected)
    return counts.join(F.broadcast(totals), "column").groupBy("column").agg(  # one row per column
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.count("*").alias("categories"),
        F.when(F.count_if(F.col("r") == 0) == 0, F.sum(term)).alias("chi2"))


def drift_report(reference: DataFrame, current: DataFrame, ks_threshold: float = KS_THRESHOLD, bins: int = 10,
                 rows: int | None = None, bucket_rows: int = BUCKET_ROWS,
                 check_ts: dt.datetime | None = None) -> DataFrame:
    """One row per shared column; numbers by KS and PSI, everything else by chi-square.

    Tail probabilities are scalar code on the one row that each column has.
    """
    spark = reference.sparkSession
    shared = shared_columns(reference, current)
    numeric = [c for c in numeric_columns(reference) if c in shared and c in numeric_columns(current)]
    other = [c for c in shared if c not in numeric and c in
             {*boolean_columns(reference), *date_columns(reference),
              *[f.name for f in reference.schema if f.dataType.typeName() == "string"]}]
    ts = check_ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    out: dict[str, tuple] = {}
    if numeric:
        if rows is None:
            rows = reference.count() + current.count()
        stats = ks_statistics(reference, current, numeric, rows, bucket_rows).join(
            psi_statistics(reference, current, numeric, bins), "column", "left")
        for s in stats.collect():
            if not s["n_cur"] or not s["n_ref"]:
                continue
            enough = s["n_ref"] >= MIN_KS_ROWS and s["n_cur"] >= MIN_KS_ROWS
            ks = s["ks"] if enough else 0.0
            p = kolmogorov_p(ks, s["n_ref"], s["n_cur"]) if enough else 1.0
            psi = s["psi"] or 0.0
            out[s["column"]] = (ts, s["column"], "numeric", s["n_ref"], s["n_cur"], ks, p, psi, None, None,
                                (enough and ks > ks_threshold) or psi > PSI_THRESHOLD)
    if other:
        for s in chi2_statistics(reference, current, other).collect():
            if not s["n_cur"] or not s["n_ref"]:
                continue
            chi2 = s["chi2"]
            p = 0.0 if chi2 is None else chi2_sf(chi2, s["categories"] - 1)
            out[s["column"]] = (ts, s["column"], "categorical", s["n_ref"], s["n_cur"], None, None, None, chi2, p,
                                p < CHI2_ALPHA)
    return spark.createDataFrame([out[c] for c in shared if c in out], SCHEMA)


def drift_summary(report: DataFrame, columns_checked: int) -> DataFrame:
    """Drifted columns, drift rate over the shared columns, overall flag."""
    n = F.coalesce(F.count_if("drifted"), F.lit(0))
    return report.agg(
        n.alias("drifted_columns"), F.round(n / float(max(columns_checked, 1)), 4).alias("drift_rate"),
        (n > 0).alias("overall_drift"))

"""Drift of an event stream against a fixed reference, per time window.

The reference is reduced once to bins: equal-width bins on its own range for numbers (values
outside fall in the end bins) and its categories for texts.  The stream then only counts
(window, column, bin), so state is bounded by the reference, not by the traffic.  The same
functions run on a static table, which is the batch twin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tabsmith.functions.expr import divide, equal_width_bin, numeric_columns, ref, string_columns, unpivot_strings
from tabsmith.functions.session import BROADCAST_ROWS, cut_lineage
from tabsmith.operators.drift import KS_THRESHOLD, PSI_FLOOR, PSI_THRESHOLD
from tabsmith.operators.stats import clean_values, summarize

NEW = "(new)"


@dataclass
class ReferenceBins:
    numeric: dict[str, tuple[float, float]]
    strings: list[str]
    bins: int
    table: DataFrame  # column, kind, bin, r, n_ref
    small: bool = True  # counted: the table may be broadcast

    def spread(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small else table


def _numeric_bins(df: DataFrame, bounds: dict[str, tuple[float, float]], bins: int, keep: Sequence[str] = ()) -> DataFrame:
    values = clean_values(df, list(bounds))
    structs = [
        F.struct(F.lit(c).alias("column"),
                 equal_width_bin(values[c], F.lit(float(lo)), F.lit(float(hi)), bins).cast("string").alias("bin"))
        for c, (lo, hi) in bounds.items()
    ]
    return df.select(*[ref(k) for k in keep], F.inline(F.array(*structs))).where("bin is not null").withColumn("kind", F.lit("numeric"))


def _string_bins(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    long = unpivot_strings(df, cols, keep).where("value is not null")
    return long.withColumnRenamed("value", "bin").withColumn("kind", F.lit("categorical"))


def reference_bins(reference: DataFrame, cols: Sequence[str], bins: int = 10) -> ReferenceBins:
    """Bins of the reference.  Beyond ``BROADCAST_ROWS`` categories they stay a table that is joined."""
    spark = reference.sparkSession
    numeric = [c for c in numeric_columns(reference) if c in cols]
    strings = [c for c in string_columns(reference) if c in cols]
    stats = summarize(reference, numeric, (), moments=0) if numeric else {}
    bounds = {c: (s.lo, s.hi) for c, s in stats.items() if s.n}
    parts = None
    for part in ([_numeric_bins(reference, bounds, bins)] if bounds else []) + ([_string_bins(reference, strings)] if strings else []):
        part = part.select("column", "kind", "bin")
        parts = part if parts is None else parts.unionByName(part)
    counted = parts.groupBy("column", "kind", "bin").agg(F.count("*").alias("r"))
    rows = counted.limit(BROADCAST_ROWS + 1).collect()
    small = len(rows) <= BROADCAST_ROWS
    if not small:
        counted = cut_lineage(counted)
        rows = counted.where("kind = 'numeric'").collect()  # columns times bins
    have = {(r["column"], r["bin"]): r["r"] for r in rows}
    full = [(c, "numeric", str(b), have.get((c, str(b)), 0)) for c in bounds for b in range(bins)]
    full += [(r["column"], r["kind"], r["bin"], r["r"]) for r in rows if r["kind"] == "categorical"]
    if not small:
        grid = spark.createDataFrame(full, "column string, kind string, bin string, r long")
        table = grid.unionByName(counted.where("kind = 'categorical'"))
        totals = table.groupBy("column").agg(F.sum("r").alias("n_ref"))
        return ReferenceBins(bounds, strings, bins, cut_lineage(table.join(F.broadcast(totals), "column")), False)
    totals: dict[str, int] = {}
    for c, _, _, n in full:
        totals[c] = totals.get(c, 0) + n
    table = spark.createDataFrame([(*row, totals[row[0]]) for row in full],
                                  "column string, kind string, bin string, r long, n_ref long")
    return ReferenceBins(bounds, strings, bins, table)


def window_counts(df: DataFrame, bins: ReferenceBins, ts: str, length: str = "60 minutes", late: str | None = None) -> DataFrame:
    """``(window_start, column, kind, bin, c)``; works on streams (give ``late``) and tables."""
    df = df.withColumn("_ts", ref(ts).cast("timestamp"))
    if late:
        df = df.withWatermark("_ts", late)
    values = clean_values(df, list(bins.numeric))
    structs = [
        F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("kind"),
                 equal_width_bin(values[c], F.lit(float(lo)), F.lit(float(hi)), bins.bins).cast("string").alias("bin"))
        for c, (lo, hi) in bins.numeric.items()
    ] + [
        F.struct(F.lit(c).alias("column"), F.lit("categorical").alias("kind"), ref(c).alias("bin")) for c in bins.strings
    ]
    long = df.select("_ts", F.inline(F.array(*structs))).where("bin is not null")
    if bins.strings:
        # A static lookup whose size was counted when the bins were built.
        known = bins.table.where("kind = 'categorical'").select("column", "bin", F.lit(True).alias("_known"))
        long = long.join(bins.spread(known), ["column", "bin"], "left").withColumn(
            "bin", F.when((F.col("kind") == "numeric") | F.col("_known"), F.col("bin")).otherwise(NEW))
    counts = long.groupBy(F.window("_ts", length).alias("w"), "column", "kind", "bin").agg(F.count("*").alias("c"))
    return counts.select(F.col("w.start").alias("window_start"), "column", "kind", "bin", "c")


def score_windows(counts: DataFrame, bins: ReferenceBins) -> DataFrame:
    """One row per window and column: ks (on the binned distributions), psi, chi2, drifted."""
    totals = counts.groupBy("window_start", "column", "kind").agg(
        F.sum("c").alias("n_cur"), F.sum(F.when(F.col("bin") == NEW, F.col("c")).otherwise(0)).alias("n_new"))
    frame = totals.join(bins.spread(bins.table.drop("kind")), "column")
    cells = frame.join(counts.select("window_start", "column", "bin", "c"), ["window_start", "column", "bin"], "left")
    c, r = F.coalesce("c", F.lit(0)), F.col("r")
    p = F.when(r == 0, F.lit(PSI_FLOOR)).otherwise(divide(r, F.col("n_ref")))
    q = F.when(c == 0, F.lit(PSI_FLOOR)).otherwise(divide(c, F.col("n_cur")))
    both_empty = (r == 0) & (c == 0)
    numeric = F.col("kind") == "numeric"
    w = Window.partitionBy("window_start", "column").orderBy(F.col("bin").try_cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum(divide(r, F.col("n_ref"))).over(w) - F.sum(divide(c, F.col("n_cur"))).over(w))
    expected = r * F.col("n_cur") / F.col("n_ref")
    out = cells.withColumn("_gap", F.when(numeric, gap)).groupBy("window_start", "column", "kind").agg(
        F.max("n_cur").alias("n_cur"), F.max("_gap").alias("ks"),
        F.sum(F.when(numeric & ~both_empty, (q - p) * F.ln(q / p))).alias("psi"),
        F.when(F.max("n_new") == 0, F.sum(F.when(~numeric, divide((c - expected) * (c - expected), expected)))).alias("chi2"),
        F.max("n_new").alias("n_new"), F.count("*").alias("_bins"))
    # The 5 % point of chi-square by the Wilson-Hilferty formula keeps the test in SQL.
    k = F.col("_bins") - 1
    point = k * F.pow(1 - F.lit(2.0 / 9.0) / k + F.lit(1.6448536269514722) * F.sqrt(F.lit(2.0 / 9.0) / k), F.lit(3.0))
    drifted = F.when(F.col("kind") == "numeric", (F.col("ks") > KS_THRESHOLD) | (F.col("psi") > PSI_THRESHOLD)).otherwise(
        (F.col("n_new") > 0) | ((k > 0) & (F.col("chi2") > point)))
    return out.withColumn("drifted", F.coalesce(drifted, F.lit(False))).drop("_bins")


def windowed_drift(df: DataFrame, bins: ReferenceBins, ts: str, length: str = "60 minutes") -> DataFrame:
    """Batch twin of the monitor."""
    return score_windows(window_counts(df, bins, ts, length), bins)


def monitor(stream: DataFrame, bins: ReferenceBins, ts: str, path: str, checkpoint: str, length: str = "60 minutes",
            late: str = "10 minutes") -> DataStreamWriter:
    """Writer of finished windows to parquet under ``path``; start it with ``.start()``.

    A window is emitted once, when the watermark passes its end, with all its bins in the
    same batch; scoring it is then an ordinary small job.  A batch writes its own folder and
    overwrites it when repeated, so a retry does not duplicate windows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score_windows(batch, bins).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    counts = window_counts(stream, bins, ts, length, late)
    return counts.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)

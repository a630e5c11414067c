"""Profiles from stored sketches: files added later need no second look at the old ones.

Each part of a source (a load, a day, a file) is scanned once.  For every column it leaves a row with its counts, sums,
extremes and two mergeable sketches: KLL for ranks of numbers, HLL for distinct values.  A profile merges the rows of the
parts, whatever their number, and never reads the source again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.expr import numeric_columns, ref, string_columns
from tabsmith.operators.stats import clean_values

# Size of the KLL sketch (normalised rank error about 1.3 % at 200, 0.33 % at 800) and bits of the HLL registers' index
# (standard error of a distinct count 1.04 / sqrt(2^bits), 0.8 % at 14).
KLL_SIZE, HLL_BITS = 800, 14
SKETCHES = ("part string, column string, type string, rows long, present long, total double, square double, low double, high double, ranks binary, distinct binary")


def rank_error(size: int = KLL_SIZE) -> float:
    """Bound of the normalised rank error of a KLL sketch, at 99 % confidence."""
    return 2.296 / size**0.9021


def column_sketches(df: DataFrame, part: Column, cols: Sequence[str] | None = None) -> DataFrame:
    """One row for each part and column of ``SKETCHES``; ``part`` names the part of a row, null and NaN are missing.

    All columns of a part are sketched in one scan, and tasks combine before the shuffle.  Text columns have no ranks,
    sums or extremes.  Columns of other types are left out.
    """
    numbers = [c for c in numeric_columns(df) if cols is None or c in cols]
    texts = [c for c in string_columns(df) if cols is None or c in cols]
    values = clean_values(df, numbers)
    wide = df.select(part.cast("string").alias("part"), *(values[c].cast("double").alias(f"v{i}") for i, c in enumerate(numbers)), *(ref(c).alias(f"t{i}") for i, c in enumerate(texts)))
    aggs = [F.count("*").alias("rows")]
    for i in range(len(numbers)):
        v = f"v{i}"
        aggs += [F.count(v).alias(f"n_{v}"), F.sum(v).alias(f"s_{v}"), F.sum(F.col(v) * F.col(v)).alias(f"q_{v}"), F.min(v).alias(f"l_{v}"), F.max(v).alias(f"h_{v}"),
                 F.kll_sketch_agg_double(v, F.lit(KLL_SIZE)).alias(f"k_{v}"), F.hll_sketch_agg(F.xxhash64(v), F.lit(HLL_BITS)).alias(f"d_{v}")]
    for i in range(len(texts)):
        aggs += [F.count(f"t{i}").alias(f"n_t{i}"), F.hll_sketch_agg(f"t{i}", F.lit(HLL_BITS)).alias(f"d_t{i}")]
    found = wide.groupBy("part").agg(*aggs)
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("type"), "rows", F.col(f"n_v{i}").alias("present"), F.col(f"s_v{i}").alias("total"), F.col(f"q_v{i}").alias("square"),
                     F.col(f"l_v{i}").alias("low"), F.col(f"h_v{i}").alias("high"), F.col(f"k_v{i}").alias("ranks"), F.col(f"d_v{i}").alias("distinct")) for i, c in enumerate(numbers)]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("text").alias("type"), "rows", F.col(f"n_t{i}").alias("present"), none.alias("total"), none.alias("square"), none.alias("low"),
                      none.alias("high"), F.lit(None).cast("binary").alias("ranks"), F.col(f"d_t{i}").alias("distinct")) for i, c in enumerate(texts)]
    if not rows:
        return df.sparkSession.createDataFrame([], SKETCHES)
    return found.select("part", F.inline(F.array(*rows)))


def append_sketches(df: DataFrame, part: Column, path: str, cols: Sequence[str] | None = None) -> None:
    """Sketch the rows of ``df`` and add them to the table at ``path``.

    A part that the table has already raises, before anything is written: its rows would count twice.
    """
    spark = df.sparkSession
    new = column_sketches(df, part, cols).persist()
    try:
        known = stored_sketches(spark, path)
        if known is not None and not known.join(new.select("part").distinct(), "part", "left_semi").isEmpty():
            raise ValueError("the table has sketches of one of these parts")
        new.write.mode("append").parquet(path)
    finally:
        new.unpersist()


def stored_sketches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(SKETCHES).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return None


def profile_of(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, type, parts, rows, missing, distinct, mean, std, low, high, quantiles)`` of all parts together.

    Counts, sums and extremes are exact; ``distinct`` and ``quantiles`` are as near as the sketches are, and do not
    depend on how rows were dealt to parts beyond that.  Standard deviations are of samples.
    """
    found = sketches.groupBy("column", "type").agg(
        F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.sum("total").alias("total"), F.sum("square").alias("square"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("distinct").alias("sketch"))
    n = F.col("present")
    mean = F.try_divide("total", n)
    spread = F.greatest(F.try_divide(F.col("square") - F.col("total") * mean, n - 1), F.lit(0.0))
    quantiles = F.when((F.col("type") == "numeric") & (n > 0), F.kll_sketch_get_quantile_double("ranks", F.array(*(F.lit(float(p)) for p in probs))))
    return found.select("column", "type", "parts", "rows", (F.col("rows") - n).alias("missing"), F.hll_sketch_estimate("sketch").alias("distinct"), mean.alias("mean"),
                        F.when(n > 1, F.sqrt(spread)).alias("std"), "low", "high", quantiles.alias("quantiles"))


def rank_of(sketches: DataFrame, column: str, value: float) -> float:
    """Share of the column's values that are at most ``value``."""
    merged = sketches.where(F.col("column") == column).agg(F.kll_merge_agg_double("ranks").alias("ranks"))
    return merged.select(F.kll_sketch_get_rank_double("ranks", F.lit(float(value)))).first()[0]

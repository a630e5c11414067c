"""Model quality measures as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import divide, ref
from tabsmith.functions.session import BUCKET_ROWS
from tabsmith.operators.order_stats import running_totals


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, n)``."""
    return df.groupBy(ref(label).alias("label"), ref(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """accuracy, f1_weighted, f1_macro (0/0 counts as 0)."""
    cells = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.inline(F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                     hit.cast("long").alias("tp")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                     F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
        ))
    )
    per_class = sides.groupBy("class").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    f1 = F.coalesce(divide(2.0 * F.col("tp"), F.col("actual") + F.col("predicted")), F.lit(0.0))
    return per_class.agg(
        divide(F.sum("tp"), F.sum("actual")).alias("accuracy"),
        divide(F.sum(f1 * F.col("actual")), F.sum("actual")).alias("f1_weighted"),
        F.avg(f1).alias("f1_macro"),
    )


def roc_auc(df: DataFrame, positive: str, score: str, rows: int | None = None,
            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Binary AUC by rank sum with average ties; ``positive`` is 0/1.

    Scores are reduced to distinct values with class counts before ranking.
    """
    rows = df.count() if rows is None else rows
    counts = (
        df.where(ref(score).isNotNull())
        .groupBy(F.lit(0).alias("g"), ref(score).cast("double").alias("v"))
        .agg(F.sum((ref(positive) == 1).cast("long")).alias("p"), F.count("*").alias("t"))
    )
    ranked = running_totals(counts, ["g"], "v", ["t"], rows, bucket_rows)
    rank = F.col("cum_t") - (F.col("t") - 1) / 2.0
    sums = ranked.agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("np"), F.sum("t").alias("nt"))
    p, q = F.col("np").cast("double"), (F.col("nt") - F.col("np")).cast("double")
    return sums.select(divide(F.col("r") - p * (p + 1) / 2.0, p * q).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, label: str, scores: dict[float, str], rows: int | None = None,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One-vs-rest AUC averaged by class size; ``scores`` maps class to its score column.

    All classes are ranked in one job, in long form.
    """
    rows = df.count() if rows is None else rows
    structs = [
        F.struct(F.lit(str(c)).alias("g"), ref(s).cast("double").alias("v"), (ref(label) == c).cast("long").alias("y"))
        for c, s in scores.items()
    ]
    counts = (
        df.select(F.inline(F.array(*structs))).where("v is not null")
        .groupBy("g", "v").agg(F.sum("y").alias("p"), F.count("*").alias("t"))
    )
    ranked = running_totals(counts, ["g"], "v", ["t"], rows, bucket_rows)
    rank = F.col("cum_t") - (F.col("t") - 1) / 2.0
    sums = ranked.groupBy("g").agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("np"), F.sum("t").alias("nt"))
    p, q = F.col("np").cast("double"), (F.col("nt") - F.col("np")).cast("double")
    auc = sums.select(divide(F.col("r") - p * (p + 1) / 2.0, p * q).alias("auc"), p.alias("w")).where("auc is not null")
    return auc.agg(divide(F.sum(F.col("auc") * F.col("w")), F.sum("w")).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """rmse, mae, r2 and mape (percent of |y| + 1e-8)."""
    y, e = ref(label).cast("double"), ref(label).cast("double") - ref(prediction).cast("double")
    a = df.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("vy"),
        (100.0 * F.avg(F.abs(e) / (F.abs(y) + 1e-8))).alias("mape"),
    )
    return a.select(F.sqrt("mse").alias("rmse"), "mae", (1.0 - divide(F.col("mse"), F.col("vy"))).alias("r2"), "mape")


def error_table(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows, errors and error rate per true class."""
    wrong = (ref(label) != ref(prediction)).cast("long")
    return df.groupBy(ref(label).alias("label")).agg(
        F.count("*").alias("n"), F.sum(wrong).alias("errors"), F.avg(wrong.cast("double")).alias("error_rate"))

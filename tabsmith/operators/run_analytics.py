"""Many runs as tables: statistics, comparison, diagnosis.

``runs``: run_id, dataset, status, problem_type, target, n_rows, n_cols;
``leaderboard``: run_id, model_name, score (accuracy or r2);
``importance``: run_id, feature, importance;  ``classes``: run_id, class, n;
``missing``: run_id, column, pct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import divide


def best_models(leaderboard: DataFrame) -> DataFrame:
    """``(run_id, best_model, best_score, second_score, n_models)``.

    Per run only the two best scores are kept while aggregating, so no run is collected.
    """
    top = leaderboard.groupBy("run_id").agg(
        F.max("score").alias("best_score"), F.count("*").alias("n_models"),
        F.min_by("model_name", F.struct((-F.col("score")).alias("s"), "model_name")).alias("best_model"))
    w = Window.partitionBy("run_id").orderBy(F.desc("score"), "model_name")
    second = leaderboard.withColumn("r", F.row_number().over(w)).where("r <= 2").where("r = 2").select(
        "run_id", F.col("score").alias("second_score"))
    return top.join(second, "run_id", "left")


def run_statistics(runs: DataFrame, leaderboard: DataFrame) -> DataFrame:
    """Counts by status, models trained, mean best accuracy and r2 of completed runs."""
    best = leaderboard.groupBy("run_id").agg(F.max("score").alias("best"), F.count("*").alias("n_models"))
    joined = runs.join(best, "run_id", "left")
    done = F.col("status") == "completed"
    of = lambda kind: F.avg(F.when(done & (F.col("problem_type") == kind), F.col("best")))
    return joined.agg(
        F.count("*").alias("total_runs"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "training").alias("training"),
        F.sum(F.when(done, F.coalesce("n_models", F.lit(0))).otherwise(0)).alias("total_models"),
        F.round(of("classification"), 4).alias("avg_best_accuracy"), F.round(of("regression"), 4).alias("avg_best_r2"))


def list_runs(runs: DataFrame, status: str | None = None) -> DataFrame:
    return runs if status is None else runs.where(F.col("status") == status)


def compare_runs(runs: DataFrame, leaderboard: DataFrame, wanted: DataFrame | Sequence) -> DataFrame:
    """Completed runs among ``wanted`` (a table with run_id, or ids) with their best model."""
    done = runs.where("status = 'completed'")
    if isinstance(wanted, DataFrame):
        done = done.join(wanted.select("run_id"), "run_id", "left_semi")
    else:
        done = done.where(F.col("run_id").isin(list(wanted)))
    return done.join(best_models(leaderboard), "run_id", "left")


def top_features(importance: DataFrame, k: int = 8) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_band(score: Column) -> Column:
    return F.when(score >= 0.95, "exceptional").when(score >= 0.85, "strong").when(score >= 0.70, "decent").otherwise("low")


def insights(runs: DataFrame, leaderboard: DataFrame, importance: DataFrame) -> DataFrame:
    """Score band and three leading predictors of each completed run."""
    best = leaderboard.groupBy("run_id").agg(F.max("score").alias("best_score"))
    lead = top_features(importance, 3).groupBy("run_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",").alias("top_predictors"))
    return (runs.where("status = 'completed'").join(best, "run_id", "left").join(lead, "run_id", "left")
            .select("run_id", score_band(F.coalesce("best_score", F.lit(0.0))).alias("band"), "best_score", "top_predictors"))


PENALTY = {"critical": 30, "warning": 15, "info": 5, "healthy": 0}


def diagnose(runs: DataFrame, leaderboard: DataFrame, importance: DataFrame, classes: DataFrame, missing: DataFrame) -> DataFrame:
    """Findings ``(run_id, severity, category, value)`` of completed runs.

    Each source is reduced to one row per run; the findings are then expressions.
    """
    best = best_models(leaderboard).select("run_id", "best_score", "second_score")
    lead = importance.groupBy("run_id").agg(F.max("importance").alias("top"), F.sum("importance").alias("all"))
    balance = classes.groupBy("run_id").agg(divide(F.min("n"), F.max("n")).alias("ratio"), F.count("*").alias("n_classes"))
    gaps = missing.groupBy("run_id").agg(F.count_if(F.col("pct") > 30).alias("heavy"))
    facts = runs.where("status = 'completed'")
    for part in (best, lead, balance, gaps):
        facts = facts.join(part, "run_id", "left")
    s = F.coalesce("best_score", F.lit(0.0))
    gap = F.abs(F.col("best_score") - F.col("second_score"))

    def finding(when: Column, severity: Column, category: Column, value: Column) -> Column:
        return F.when(when, F.struct(severity.alias("severity"), category.alias("category"), value.cast("double").alias("value")))

    level = F.when(s >= 0.95, "warning").when(s >= 0.85, "healthy").when(s >= 0.70, "warning").otherwise("critical")
    found = F.filter(F.array(
        finding(F.lit(True), level, F.when(s >= 0.95, "leakage_risk").otherwise("performance"), s),
        finding(gap < 0.003, F.lit("info"), F.lit("ensemble_opportunity"), gap),
        finding(F.col("top") > 0.5 * F.col("all"), F.lit("warning"), F.lit("feature_dominance"), F.col("top")),
        finding((F.col("problem_type") == "classification") & (F.col("n_classes") >= 2) & (F.col("ratio") < 0.2),
                F.lit("warning"), F.lit("class_imbalance"), F.col("ratio")),
        finding(F.col("heavy") > 0, F.lit("warning"), F.lit("missing_data"), F.col("heavy")),
        finding((F.col("n_rows") > 0) & (F.col("n_rows") < 500), F.lit("warning"), F.lit("dataset_size"), F.col("n_rows")),
    ), lambda x: x.isNotNull())
    return facts.select("run_id", F.inline(found))


def health(findings: DataFrame) -> DataFrame:
    """``(run_id, health, score, n_findings)``."""
    cost = F.lit(0)
    for severity, points in PENALTY.items():
        cost = F.when(F.col("severity") == severity, points).otherwise(cost)
    return findings.groupBy("run_id").agg(
        F.when(F.max((F.col("severity") == "critical").cast("int")) == 1, "critical")
        .when(F.max((F.col("severity") == "warning").cast("int")) == 1, "warning").otherwise("healthy").alias("health"),
        F.greatest(F.lit(0), F.lit(100) - F.sum(cost)).alias("score"), F.count("*").alias("n_findings"))

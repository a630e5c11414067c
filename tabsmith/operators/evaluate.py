"""Metric dictionaries of scored rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.metrics import classification_metrics, regression_metrics, roc_auc, roc_auc_ovr


def evaluate(scored: DataFrame, classification: bool, classes: int = 0) -> dict[str, float]:
    """accuracy, f1_weighted, f1_macro and roc_auc, or rmse, mae, r2 and mape; 4 digits."""
    if not classification:
        row = regression_metrics(scored, "label", "prediction").first()
        return {k: round(v, 4) for k, v in row.asDict().items() if v is not None}
    rows = scored.select("label", "prediction", *(
        [vector_to_array("probability").alias("q")] if "probability" in scored.columns else []))
    out = {k: round(v, 4) for k, v in classification_metrics(rows, "label", "prediction").first().asDict().items()
           if v is not None}
    if "q" in rows.columns:
        n = rows.count()
        if classes == 2:
            binary = rows.select(F.col("label").alias("y"), F.get("q", F.lit(1)).alias("s"))
            auc = roc_auc(binary, "y", "s", n).first()[0]
        else:
            wide = rows.select("label", *[F.get("q", F.lit(c)).alias(f"s{c}") for c in range(classes)])
            auc = roc_auc_ovr(wide, "label", {float(c): f"s{c}" for c in range(classes)}, n).first()[0]
        if auc is not None:
            out["roc_auc"] = round(auc, 4)
    return out


def primary_metric(classification: bool) -> str:
    return "accuracy" if classification else "r2"

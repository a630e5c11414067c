"""Writing results: scored rows, drift reports, enriched tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scores(scored: DataFrame, path: str, key: list[str], fmt: str = "csv") -> None:
    """``key..., prediction, confidence`` as csv or parquet; any number of rows."""
    cols = [*key, "prediction", *(["confidence"] if "confidence" in scored.columns else [])]
    out = scored.select(*cols)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "parquet":
        out.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def append_drift_report(report: DataFrame, path: str) -> None:
    """Append to a parquet table partitioned by check date."""
    report.withColumn("check_date", F.to_date("check_ts")).write.mode("append").partitionBy("check_date").parquet(path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Materialise a table and read it back, so later steps start from files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

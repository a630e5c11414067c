"""Scoring a stream with a fitted table model: stateless, one transform per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def score_stream(stream: DataFrame, scorer, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer of scored rows as parquet; ``scorer`` maps a DataFrame to a scored DataFrame."""
    return scorer(stream).writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)

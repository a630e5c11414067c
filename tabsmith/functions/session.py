"""Session helpers: sizes that bound broadcasts, and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A lookup table is broadcast only when its counted rows are at most this many.
BROADCAST_ROWS = 200_000
# Rows that one task may sort in a window before ranks are computed by buckets.
BUCKET_ROWS = 1_000_000
# Category maps up to this size travel inside a fitted model; larger ones stay tables.
INLINE_CATEGORIES = 2_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, in the folder the session names, that survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names.  Only a local session may do without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tabsmith-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables and streams that executors write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"

"""The shared folder for checkpoints (the cluster's, or a temporary one in a local session), and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder, for files that a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/tallyframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def broadcast_counted(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``limit`` rows by count; beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df

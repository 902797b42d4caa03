"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The table as a checkpoint in the cluster's shared folder; a local session without one gets its own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_base(spark))
    return df.checkpoint()


def _base(spark) -> str:
    """The folder that the cluster names; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base


def shared_folder(spark) -> str:
    """A new folder beside the checkpoints, where driver and executors can meet."""
    return f"{_base(spark).rstrip('/')}/{uuid.uuid4().hex}"

"""Session helpers shared by the operators."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one.

    The folder named by ``spark.checkpoint.dir`` is used; where that is unset, a
    session within one process (as in tests) makes a temporary one, and any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text): one aggregate row."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def pieces_for(total: int, each: int, least: int) -> int:
    return max(least, math.ceil(total / each), 1)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others as one struct ``_row``, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*(rest or [F.lit(True).alias("_none")])).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that ``packed`` was given, some of them with new values."""
    return df.select(*[new.get(c, F.col(c) if c in df.columns and c in ("doc_id", "text") else F.col(f"_row.`{c}`")).alias(c) for c in columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

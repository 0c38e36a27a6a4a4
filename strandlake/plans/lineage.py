"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of ``spark.checkpoint.dir``; only where none is set, in a temporary one."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all tasks see; only where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strandlake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Cutting the lineage of tables that many branches of one plan read, and the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a single machine takes a temporary folder and a cluster is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="meterlake-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from the shared folder: branches then neither recompute it nor carry its plan, and a
    lost executor costs a reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

"""Tables that are computed once and read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors reach, from spark.checkpoint.dir; only in local mode one is made where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith(("local[", "local*")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; what reads it again survives the loss of an executor and computes nothing twice."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Tables written between the steps of a plan, in a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """Where this application's steps are written: below spark.checkpoint.dir; unset, below a temporary folder, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = getattr(spark, "_tidewatch_steps", None) or tempfile.mkdtemp(prefix="tidewatch-")
        spark._tidewatch_steps = found
    return f"{found.rstrip('/')}/steps-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: its lineage ends there, so lost executors don't matter, and it isn't computed twice."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

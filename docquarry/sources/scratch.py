"""Tables written between the rounds of an iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it when the session is built."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("build the session with spark.checkpoint.dir: a folder that the driver and all executors share")
    return configured


def written(df: DataFrame) -> DataFrame:
    """``df``, checkpointed in that folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()

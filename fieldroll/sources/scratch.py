"""Where tables go that a query makes on its way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir or on the context; one on this machine only where the driver is all there is."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and (current := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = current.get()
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = "/tmp/checkpoints/fieldroll"
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: made once, whatever reads it and whatever executors are lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

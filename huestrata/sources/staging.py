"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a local master may leave that unset: there is one machine then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints/huestrata"
    return f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends here, and what reads it twice reads the same rows, whatever executors are lost."""
    path = staging_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables in the folder that all machines of a cluster share, which cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Only a session on one machine may name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as it was written there once: what depends on how tasks ran stays as it is."""
    path = folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

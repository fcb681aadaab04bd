"""Tables in the folder that the driver and all executors share: lineage ends in them, and their rows stay as they are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Only local mode, where all share one machine, may leave that unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/timbral-base"
    return f"{root.rstrip('/')}/base-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again. What depends on how rows were dealt is the same for all who read it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

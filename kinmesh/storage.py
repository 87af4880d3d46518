"""Where intermediate tables go, so that lineages end and lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="kinmesh-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/kinmesh/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

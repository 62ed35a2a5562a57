"""Cutting the lineage of steps, in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for data all executors can read. Only a local master may do without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage of a step of an iteration, in the folder that the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder: several readers take the columns they need, and Spark knows its size, so that small tables are broadcast."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of a few MB from now on: the default of 64 MB is held several times over by each task. A value that the cluster sets stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == str(64 * 2**20) and not df.sparkSession.sparkContext.getConf().contains(key):
        conf.set(key, str(4 * 2**20))
    return df

"""Tables for one session, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new place in the folder that `spark.checkpoint.dir` names. Only where that is
    unset, as in tests on one machine, a temporary folder takes its place, which goes
    at the end of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not hasattr(spark, "_scene_scratch"):
            spark._scene_scratch = tempfile.mkdtemp(prefix="scene-scratch-")
            atexit.register(shutil.rmtree, spark._scene_scratch, True)
        folder = f"file://{spark._scene_scratch}"
    return f"{folder}/scenes/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written as a table and read again, so that a lost executor costs a few
    tasks and no stage before the write."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Folders that the driver and all executors see, and tables written there to cut a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir. Where that is unset: a local one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "quirefold-shared")
    return f"{base.rstrip('/')}/quirefold-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path there."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a shared folder: later reads prune its columns, and a lost executor costs one reading."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes all that this application has written to shared folders; call it when no result is read any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_base(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

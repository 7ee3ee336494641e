"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a local session gets one under /tmp, and a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    folder = f"{base.rstrip('/')}/revmine/{purpose}-{uuid.uuid4().hex}"
    atexit.register(_drop, folder)
    return folder


def _drop(folder: str) -> None:
    """Results are read lazily, so a folder lives as long as the driver."""
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    try:
        system, path = fs.FileSystem.from_uri(uri)
        system.delete_dir(path)
    except (OSError, pa.ArrowException):
        pass  # never written, or in a store that only Spark reaches


def written(df: DataFrame, path: str) -> DataFrame:
    """The frame as a Parquet table at path, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

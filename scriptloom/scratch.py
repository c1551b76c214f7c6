"""Intermediate tables in the folder that driver and executors share.

A table written here cuts the lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-scratch-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset one of our own, on a local master only.

    On a cluster each executor would write to its own disk, so there a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{_own_folder()}"
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return a reader of it."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

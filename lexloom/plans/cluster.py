"""Folders that a cluster shares, and lineage cut by them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and every executor can reach.

    It lies below `spark.checkpoint.dir`. Where that is unset, a local session gets a
    folder of this machine; a cluster has none that all its machines share, so there
    it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = tempfile.mkdtemp(prefix="lexloom-")
    return f"{base.rstrip('/')}/lexloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(os.path.dirname(shared_dir(df.sparkSession)))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a shared store, whatever its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

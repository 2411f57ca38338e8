"""The folder that driver and executors share, and lineage cut there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: what spark.checkpoint.dir names.

    A folder of this machine is taken only where that is unset and the driver runs the tasks itself (a local master);
    executors elsewhere could not read it, so a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """`df.checkpoint()` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session wrote, wherever Spark's file systems hold it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

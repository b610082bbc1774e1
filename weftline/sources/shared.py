"""Small intermediate results that several branches of a plan read are cut in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests) a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            given = tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(given)
    return context.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """``df`` made once, in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whichever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def taken(df: DataFrame, *paths: str) -> DataFrame:
    """``df`` made once, and then the folders that it was read from removed, also if it fails."""
    try:
        return once(df)
    finally:
        for path in paths:
            remove(df.sparkSession, path)

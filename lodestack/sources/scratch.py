"""Folders that driver and executors share, for tables that a query writes and reads again, and states that are replaced whole."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or (unset in a single local process, as in tests) in a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='lodestack-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/lodestack/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace(df: DataFrame, path: str) -> None:
    """Write a state beside the old one, then put it in its place by renames: a reader sees the old or the new one, never a part.

    Between the two renames there is none for a moment, which ``read_state`` waits out.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    df.write.parquet(fresh)
    fs, place = _fs(spark, path)
    java = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(java(old), True)
    if fs.exists(place):
        fs.rename(place, java(old))
    fs.rename(java(fresh), place)


def read_state(spark: SparkSession, path: str, tries: int = 5, wait: float = 0.2) -> DataFrame:
    """The state at a path; tried again for a short while if it is not there."""
    for left in range(tries, 0, -1):
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            if left == 1:
                raise
            time.sleep(wait)
    raise ValueError("no tries")


def resume(df: DataFrame, path: str, part: str) -> None:
    """Write the parts of a table (values of the column ``part``) that are not there yet; a part appears whole or not at all, as each
    run commits its files together."""
    fs, place = _fs(df.sparkSession, path)
    left = df
    if fs.exists(place) and len(fs.listStatus(place)):
        done = df.sparkSession.read.parquet(path).select(part).distinct()
        left = df.join(done, part, "left_anti")
    left.write.mode("append").partitionBy(part).parquet(path)

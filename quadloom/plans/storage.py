"""Intermediate tables in the shared folder that driver and executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a folder of our own in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_before.get() if set_before.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.sparkContext.setCheckpointDir(found)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read again: the plan so far is cut off, and its columns get new identities."""
    path = f"{work_folder(df.sparkSession)}/quadloom/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM has ended: what is left goes with the checkpoint folder
            return

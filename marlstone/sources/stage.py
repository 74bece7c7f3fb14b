"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 1 << 16  # rows of terms or keys that are broadcast


@functools.cache
def _local_shared() -> str:
    return tempfile.mkdtemp(prefix="marlstone-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_local_shared()}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet and read it back: computed once, lineage cut, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/marlstone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """Staged rows, broadcast if they are at most that many: what they meet then stays where it is, however Spark judges sizes."""
    return F.broadcast(rows) if rows.count() <= most else rows

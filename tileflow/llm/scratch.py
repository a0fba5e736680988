"""Staged tables in the folder that all executors share.

A stage that is read more than once, or whose lineage must end, is written as
Parquet below ``spark.checkpoint.dir``. Files there outlive any executor, so a
lost executor costs the tasks it ran and nothing that was staged before.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used by single-machine sessions (tests) that configure no shared folder.
LOCAL_DEFAULT = "/tmp/checkpoints/tileflow"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a local[*] session may lack one."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_DEFAULT


#: Paths staged within each open ``passing`` block.
_PASSING: list[list[str]] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back, with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    for paths in _PASSING:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing(spark: SparkSession, keep: str) -> Iterator[None]:
    """What is staged inside the block is deleted at its end, but for tables of the label ``keep``: the block's results."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            if f"/{keep}-" not in path:
                _delete(spark, path)


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this application staged. Call when its results have been written."""
    _delete(spark, f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 64 << 20) -> None:
    """Bound the rows and the bytes an Arrow batch hands to a Python worker: whole texts can be long.

    Sets the session's limits, as batches are made when a result is computed, and leaves stricter ones alone."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) if now else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))

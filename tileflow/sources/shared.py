"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder for single-machine sessions."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/tileflow"
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """Path of the shared folder on nodes that mount it."""
    path = base(spark).removeprefix("file://")
    if not path.startswith("/"):
        raise RuntimeError(f"a file store needs a mounted folder, not {path}")
    return path


def _staged(spark: SparkSession) -> str:
    return f"{base(spark)}/engine/{spark.sparkContext.applicationId}"


def own_folder(spark: SparkSession) -> str:
    """Path for stores that live as long as this application's staged tables."""
    return f"{folder(spark)}/engine/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back. A join with it can be split where one key has very many rows,
    as a join with the output of an aggregation on that key cannot; and a lost executor costs nothing that was written."""
    path = f"{_staged(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what ``staged`` wrote in this application. Call when its results have been written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_staged(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

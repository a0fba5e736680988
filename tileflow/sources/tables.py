"""SQL tables as sources, and their rows as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.sources.stores import MetaFiles


def read_table(spark: SparkSession, url: str, table: str, *, split_by: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A table by jdbc, read in ``parts`` ranges of the number column ``split_by`` where one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_by:
        reader = reader.options(partitionColumn=split_by, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def parsed_time(text: Column) -> Column:
    """yyyy-mm-dd hh:mm:ss as a time without zone; null for other texts."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), text.try_cast("timestamp_ntz"))


def export_path(z: Column, x: Column, y: Column) -> Column:
    """Where an exported tile goes, below the root."""
    return F.concat(F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string")), F.lit(".png"))


def exported(rows: DataFrame) -> DataFrame:
    """rows(z, x, y, data, created_at) -> (path, mtime, data) of the files; empty tiles are skipped."""
    return rows.where(F.length("data") > 0).select(export_path(F.col("z"), F.col("x"), F.col("y")).alias("path"), F.col("created_at").alias("mtime"), F.col("data").cast("binary").alias("data"))


def export(rows: DataFrame, root: str) -> None:
    """Write the files below a folder that all nodes mount, each with the time of its row."""
    rows.sparkSession.dataSource.register(MetaFiles)
    files = exported(rows).select(F.concat(F.lit(f"{root}/"), "path").alias("path"), "mtime", F.lit(0).cast("long").alias("size"), F.col("data").alias("blob"))
    files.write.format("metatiles").option("root", root).mode("append").save()

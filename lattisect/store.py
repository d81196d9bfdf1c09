"""Intermediate tables, as Parquet in a folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor see, in one of the application's own.

    It lies under ``spark.checkpoint.dir``. Only a local master may do without that setting; it
    gets a temporary folder, since there the driver and the executor are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lattisect-checkpoints")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    It cuts the lineage: a lost executor costs the re-reading of a file and never the stages
    before it, and a table that is used twice is computed once. A row group has ``rows`` at most: readers and writers
    hold a batch of thousands of rows unless a row group ends before, which is too much where a row is large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    (df.write if rows is None else df.write.option("parquet.block.row.count.limit", rows)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """Removes the files of a table that ``written`` made, once nothing reads it any more: what was made of it must have been written too."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

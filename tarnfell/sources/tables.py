"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path (of any file system Spark reads) is a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what it holds, on any file system; one that isn't there is left alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

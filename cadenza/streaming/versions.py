"""Numbered versions of a table below a folder, each visible as a whole, the two newest kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions that were written to their end, ascending."""
    files, found = file_system(spark, root)
    names = [f.getPath().getName() for f in files.listStatus(found)] if files.exists(found) else []
    written = sorted(int(n[2:]) for n in names if n.startswith("v="))
    return [n for n in written if files.exists(file_system(spark, f"{root}/v={n}/_SUCCESS")[1])]


def write(df: DataFrame, root: str, number: int) -> None:
    """Write a version, and remove those before the last two; a reader of the last one can finish."""
    df.write.mode("overwrite").parquet(f"{root}/v={number}")
    for old in numbers(df.sparkSession, root)[:-2]:
        files, found = file_system(df.sparkSession, f"{root}/v={old}")
        files.delete(found, True)


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version, or None before the first."""
    found = numbers(spark, root)
    return spark.read.parquet(f"{root}/v={found[-1]}") if found else None

"""Whether a path exists and its removal, by Spark's own file systems, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = _of(spark, path)
    return system.exists(there)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder with all in it; false where there was none."""
    system, there = _of(spark, path)
    return system.delete(there, True)

"""Cutting lineage with reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors reach.

    A folder of this machine stands in where there is none and driver and executors are one process, as in
    tests; on a cluster the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and go on from there.

    The folder is the one that ``spark.checkpoint.dir`` names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(writer: DataFrameWriter, path: str) -> None:
    """Write, and let Spark remove the shuffle files of this write when it is done: what was written is read from its files alone."""
    conf = SparkSession.active().conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)

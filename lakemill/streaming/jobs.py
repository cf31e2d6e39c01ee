"""Structured Streaming: bronze from new landing files, late replays removed, business-day counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakemill.sources import ledger
from lakemill.sources.adapters import ZONE_HOURS


def stream_landing(spark: SparkSession, schema: StructType, path: str, files_a_batch: int = 1000) -> DataFrame:
    """New landing files, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(path)


def bronze_stream(stream: DataFrame, bronze: str, checkpoint: str):
    """Each micro-batch replaces the bronze days that it touches, once; ends when all that is there is read.

    ``sources.ledger`` says how a batch that fails or comes twice leaves each row once. The checkpoint is the writer's name:
    a stream with another checkpoint reads, and adds, everything anew.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: ledger.replace_days(batch, bronze, checkpoint, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_replays(stream: DataFrame, key: str, cursor: str, lookback: str = "60 minutes") -> DataFrame:
    """One row for each version within the lookback; the cursor must be a timestamp."""
    return stream.withWatermark(cursor, lookback).dropDuplicatesWithinWatermark([key, cursor])


def business_day_counts(stream: DataFrame, ts: str, late: str = "60 minutes") -> DataFrame:
    """Counts by business day; the day begins at 16:00 UTC, which a window's start offset says."""
    offset = f"{24 - ZONE_HOURS} hours"
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day", "1 day", offset)).agg(F.count(F.lit(1)).alias("events"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream over what is there into Parquet files and return them; no row passes through the driver.

    Both folders must be ones that all executors can reach. As in ``bronze_stream``, rows come once when a batch
    runs again; a stream without any file gives an empty table.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    spark = stream.sparkSession
    write(spark.createDataFrame([], stream.schema), 0)
    stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def run_to_totals(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregating stream over what is there; each batch writes all groups anew, and the last version is returned."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = stream.sparkSession
    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{ledger.ddl(stream)}, batch long").parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")

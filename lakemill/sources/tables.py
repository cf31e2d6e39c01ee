"""One reader for the driver's tables, through Spark's own sources only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemill.sources.contracts import Contract


def read_source(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """A source table under its declared schema: no file is opened to find one, and only the contract's columns are read."""
    return spark.read.schema(contract.columns).parquet(path).select(*contract.fields)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

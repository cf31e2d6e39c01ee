"""Tables whose days are replaced whole, each replacement exactly once, by a ledger.

A batch writes the whole new content of the days that it touches under a version of its own, then one ledger file that
names the writer, the batch and the days. Readers take, for each day, the last version that the ledger names; files that
no ledger file names are nobody's. So a batch that dies halfway leaves the table as it was and, run again, writes the same
version again; one that dies after its ledger file is known when it comes again, and does nothing. Files of days that a
batch does not touch stay as they are. A table has one writer at a time.

    <table>/days/_version=7/_ingestion_date=2026-01-02/...    <table>/ledger/version=7/...
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.files import exists, remove
from lakemill.functions.lineage import write_parquet

LEDGER = "writer string, batch long, day date, rows long, version int"
EXTRACT = ("_extract_batch_id", "_extracted_at")
DAY = "_ingestion_date"


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def read_ledger(spark: SparkSession, table: str) -> DataFrame:
    """All that batches have committed; nothing before the first."""
    path = f"{table}/ledger"
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def live_versions(spark: SparkSession, table: str) -> DataFrame:
    """(day, version, rows) of the last version of each day; a row for each day of the table."""
    last = F.max_by(F.struct("version", "rows"), "version").alias("last")
    return read_ledger(spark, table).filter("day is not null").groupBy("day").agg(last).select("day", "last.*")


def read_days(spark: SparkSession, table: str, schema: str, day: str = DAY) -> DataFrame:
    """The rows of the live version of each day; other versions are pruned by their folders. ``schema`` has the day's column."""
    path = f"{table}/days"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    live = live_versions(spark, table).select(F.col("day").alias("__day"), F.col("version").alias("__live"))
    rows = spark.read.schema(f"{schema}, _version int").parquet(path)
    return rows.join(F.broadcast(live), (F.col(day) == F.col("__day")) & (F.col("_version") == F.col("__live"))).drop("__day", "__live", "_version")


def commit(spark: SparkSession, table: str, writer: str, batch: int, version: int, entry: DataFrame) -> None:
    """One ledger file for the batch, with ``entry`` (day, rows). It appears whole or not at all."""
    #: A batch that touches no day is named too.
    named = spark.createDataFrame([(writer, batch)], "writer string, batch long").join(entry, how="left")
    named.select("writer", "batch", "day", "rows").coalesce(1).write.mode("overwrite").parquet(f"{table}/ledger/version={version}")


def next_version(spark: SparkSession, table: str, writer: str, batch: int) -> int | None:
    """The version that the batch has to write, or None if it has been committed."""
    mine = (F.col("writer") == writer) & (F.col("batch") == batch)
    seen = read_ledger(spark, table).agg(F.count_if(mine).alias("seen"), F.coalesce(F.max("version"), F.lit(0)).alias("last")).first()
    return None if seen["seen"] else seen["last"] + 1


def publish(rows: DataFrame, table: str, writer: str, batch: int, days: DataFrame | None = None, day: str = DAY) -> None:
    """Make ``rows`` the whole content of their days, and of ``days`` (one column): one without rows is empty from now on."""
    spark = rows.sparkSession
    version = next_version(spark, table, writer, batch)
    if version is None:
        return
    path, schema = f"{table}/days/_version={version}", ddl(rows)
    #: By day, where the adaptive planner cuts days that are large and joins small ones.
    write_parquet(rows.hint("rebalance", day).write.mode("overwrite").partitionBy(day), path)
    entry = spark.read.schema(schema).parquet(path).groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    if days is not None:
        entry = days.toDF("d").distinct().join(entry, F.col("d") == F.col("day"), "full").select(F.coalesce("day", "d").alias("day"), F.coalesce("rows", F.lit(0)).alias("rows"))
    commit(spark, table, writer, batch, version, entry)


def replace_days(batch: DataFrame, table: str, writer: str, number: int) -> None:
    """Replace the days of ``batch`` by what they have so far and the rows of the batch.

    Where rows name their extract, a later extract of a day replaces an earlier one, also one in the same batch; rows
    of one extract add up, so a day may come over several batches.
    """
    spark = batch.sparkSession
    if next_version(spark, table, writer, number) is None:
        return
    days = batch.select(F.col(DAY).alias("touched")).distinct()
    rows = read_days(spark, table, ddl(batch)).join(F.broadcast(days), F.col(DAY) == F.col("touched"), "left_semi").unionByName(batch)
    if set(EXTRACT) <= set(batch.columns):
        newest = rows.groupBy(F.col(DAY).alias("d")).agg(F.max(F.struct("_extracted_at", "_extract_batch_id")).alias("newest"))
        rows = rows.join(F.broadcast(newest), (F.col(DAY) == F.col("d")) & F.col("_extract_batch_id").eqNullSafe(F.col("newest._extract_batch_id"))).drop("d", "newest")
    publish(rows, table, writer, number)


def vacuum(spark: SparkSession, table: str, day: str = DAY) -> int:
    """Remove the versions that no reader takes any more, and say how many; not while readers of older versions run."""
    every, live = read_ledger(spark, table).filter("day is not null"), live_versions(spark, table).withColumnsRenamed({"day": "d", "version": "v"})
    stale = every.join(live, (F.col("day") == F.col("d")) & (F.col("version") == F.col("v")), "left_anti").select("version", "day")
    return sum(remove(spark, f"{table}/days/_version={r['version']}/{day}={r['day']}") for r in stale.toLocalIterator())

"""Incremental ingestion: extract, landing files, manifest, bronze, audit and reconciliation as Spark jobs."""

from __future__ import annotations

import hashlib
import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as Over
from pyspark.sql import functions as F

from lakemill.operators.digests import range_diff
from lakemill.operators.quality import set_diff
from lakemill.sources.adapters import ZONE_HOURS
from lakemill.sources.checksums import LEAF, checksums, listed
from lakemill.sources.contracts import CONTRACTS, Contract, conform
from lakemill.sources.windows import LOOKBACK_MINUTES, Window, effective_mode

#: Fields of an audit event, and those that no event may lack.
AUDIT = (
    "event string, extract_batch_id string, load_batch_id string, dt date, table_name string, run_mode string, extract_mode string, window_start timestamp_ntz, window_end timestamp_ntz, "
    "extract_lower timestamp_ntz, lookback_minutes bigint, source_rows bigint, rows_in_window bigint, rows_in_lookback bigint, parquet_rows bigint, bronze_rows bigint, file string, sha256 string, "
    "schema_hash string, load_job_id string, status string, error_message string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_s double"
)
REQUIRED = ("event", "dt", "table_name", "run_mode", "status", "started_at", "finished_at", "duration_s")
MANIFEST_VERSION = 1
#: File names and days from the paths of landing files.
NAME = "[^/]+$"
FOLDER = "try_to_date(regexp_extract(path, '/dt=([^/]+)/', 1), 'yyyy-MM-dd')"


def extract(df: DataFrame, contract: Contract, window: Window, requested: str = "incremental") -> DataFrame:
    """The contract's columns of the rows in the window; the mode follows the table."""
    mode = effective_mode(contract.cursor, requested)
    rows = conform(df, contract)
    return rows if mode == "full" else rows.filter(window.predicate(contract.cursor, mode))


def window_counts(df: DataFrame, cursor: str, window: Window) -> DataFrame:
    """Rows of the extract, of the day itself, and of the lookback before it, in one pass."""
    inside = F.col(cursor) >= F.lit(window.start)
    return df.filter(window.predicate(cursor, "incremental")).agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(inside).alias("rows_in_window"), F.count_if(~inside).alias("rows_in_lookback"))


def with_extract_metadata(df: DataFrame, batch: str, mode: str, at: Column, source_file: str, day: date | Column) -> DataFrame:
    return df.withColumns({"_extract_batch_id": F.lit(batch), "_extract_mode": F.lit(mode), "_extracted_at": at.cast("timestamp_ntz"), "_source_file": F.lit(source_file), "_ingestion_date": F.lit(day)})


def landing_schema(contract: Contract) -> str:
    """Columns of a landing file, known without one: an empty day may have no file at all."""
    return f"{contract.columns}, _extract_batch_id string, _extract_mode string, _extracted_at timestamp_ntz, _source_file string, _ingestion_date date"


def read_landing(spark: SparkSession, root: str, contract: Contract, day: date) -> DataFrame:
    return spark.read.schema(landing_schema(contract)).parquet(f"{root}/{contract.name}/dt={day}")


def write_landing(df: DataFrame, root: str, contract: Contract, day: date, ordered: bool = False) -> str:
    """Parquet under the table's folder for the day; the committer makes the write whole or nothing."""
    if ordered:
        df = df.repartitionByRange(contract.key).sortWithinPartitions(contract.key)
    path = f"{root}/{contract.name}/dt={day}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def write_landing_days(df: DataFrame, root: str, contract: Contract, mode: str = "overwrite") -> str:
    """Landing files of many days in one write: each row goes under the folder of its ``_ingestion_date``; ``append`` for new days only."""
    path = f"{root}/{contract.name}"
    rows = df.withColumn("dt", F.col("_ingestion_date"))
    rows.repartitionByRange("dt", contract.key).sortWithinPartitions("dt", contract.key).write.mode(mode).option("compression", "zstd").partitionBy("dt").parquet(path)
    return path


def schema_hash(contract: Contract) -> str:
    """Checksum of the declared schema of a landing file."""
    return hashlib.sha256(landing_schema(contract).encode()).hexdigest()


def _described(files: DataFrame, table: str, batch: str, mode: str, started: Column | None, finished: Column | None) -> DataFrame:
    """``files`` (dt, file, bytes, sha256, counts) with the fields of a manifest that follow from the day and the table."""
    contract = CONTRACTS[table]
    effective = effective_mode(contract.cursor, mode)
    start = F.col("dt").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(ZONE_HOURS))
    none = F.lit(None).cast("timestamp_ntz")
    began, ended = (started, finished) if started is not None else (none, none)
    files = files.withColumns({"table_name": F.lit(table), "batch_id": F.lit(batch), "status": F.lit("complete"), "manifest_version": F.lit(MANIFEST_VERSION), "run_mode": F.lit(mode), "extract_mode": F.lit(effective)})
    files = files.withColumns({"window_start": start, "window_end": start + F.make_dt_interval(F.lit(1)), "lookback_minutes": F.lit(LOOKBACK_MINUTES).cast("long"), "schema_hash": F.lit(schema_hash(contract))})
    lower = F.col("window_start") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(LOOKBACK_MINUTES)) if effective == "incremental" else none
    files = files.withColumns({"extract_lower": lower, "started_at": began, "finished_at": ended})
    return files.withColumn("duration_s", F.expr("cast(timestampdiff(MICROSECOND, started_at, finished_at) as double) / 1e6"))


def _counts(rows: DataFrame, contract: Contract) -> list[Column]:
    """Rows of an artifact, of its day itself and of the lookback before it."""
    start = F.col("_ingestion_date").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(ZONE_HOURS))
    inside = F.col(contract.cursor) >= start if contract.cursor else F.lit(True)
    return [F.count(F.lit(1)).alias("parquet_rows"), F.count_if(inside).alias("rows_in_window"), F.count_if(~inside).alias("rows_in_lookback"), F.max("_extracted_at" if "_extracted_at" in rows.columns else F.lit(None).cast("timestamp_ntz")).alias("extracted_at")]


def build_manifest(
    spark: SparkSession, root: str, table: str, day: date, batch: str, mode: str = "incremental", source_rows: int | None = None, started: Column | None = None, finished: Column | None = None
) -> DataFrame:
    """One row for each landing file of the day: size and checksum, the counts of the whole artifact, the window and the schema.

    ``source_rows`` is what the source counted; without it, the rows that landed.
    """
    files = checksums(listed(spark, f"{root}/{table}/dt={day}"), LEAF)
    landed = read_landing(spark, root, CONTRACTS[table], day)
    rows = landed.agg(*_counts(landed, CONTRACTS[table])).withColumn("source_rows", F.col("parquet_rows") if source_rows is None else F.lit(source_rows).cast("long"))
    hashed = files.select(F.regexp_extract("path", NAME, 0).alias("file"), "bytes", "sha256")
    return _described(hashed.join(F.broadcast(rows)).withColumn("dt", F.lit(day)), table, batch, mode, started, finished)


def _landing_files(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(dt, file, bytes, sha256) of all landing files of the table."""
    return checksums(listed(spark, f"{root}/{table}", recursive=True), LEAF).select(F.expr(FOLDER).alias("dt"), F.regexp_extract("path", NAME, 0).alias("file"), "bytes", "sha256")


def build_manifest_days(spark: SparkSession, root: str, table: str, extracted: DataFrame, batch: str, mode: str = "incremental", started: Column | None = None, finished: Column | None = None) -> DataFrame:
    """The manifest of all landing days: one row for each file, with the counts of what was extracted for its day."""
    rows = extracted.groupBy(F.col("_ingestion_date").alias("dt")).agg(*_counts(extracted, CONTRACTS[table])).withColumn("source_rows", F.col("parquet_rows"))
    return _described(rows.join(_landing_files(spark, root, table), "dt", "left"), table, batch, mode, started, finished)


def _embedded_schema(spark: SparkSession, path: str, contract: Contract) -> str | None:
    """What is wrong with the schema that the files themselves carry."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path).schema
    except AnalysisException:
        return "no readable file"
    kinds = lambda schema: {f.name: f.dataType.simpleString() for f in schema.fields if f.name != "dt"}
    return None if kinds(found) == kinds(spark.createDataFrame([], landing_schema(contract)).schema) else "embedded schema differs"


def _proof(spark: SparkSession, manifest: DataFrame, found: DataFrame, rows: DataFrame, by: list[str], path: str, table: str) -> DataFrame:
    """Problems of landing files: ``found`` has their checksums now, ``rows`` (dt, n) their rows."""
    contract, c = CONTRACTS[table], F.col
    joined = manifest.select(*by, "sha256", "schema_hash", "status").join(found, by, "full")
    problem = (
        F.when(c("found").isNull(), "missing file")
        .when(c("sha256").isNull(), "unknown file")
        .when(c("sha256") != c("found"), "changed file")
        .when(c("schema_hash") != schema_hash(contract), "schema changed since the extract")
        .when(c("status") != "complete", "not complete")
    )
    files = joined.select(c("dt") if "dt" in by else F.lit(None).cast("date").alias("dt"), "file", problem.alias("problem")).filter("problem is not null")
    wanted = manifest.groupBy("dt").agg(F.max("parquet_rows").alias("wanted"))
    counts = wanted.join(rows.withColumnRenamed("dt", "d"), c("dt") == c("d"), "left").filter(c("wanted") != F.coalesce("n", F.lit(0)))
    #: A day whose files are already wrong is named once.
    counts = counts.join(files.select(c("dt").alias("named")).distinct(), c("dt") == c("named"), "left_anti")
    out = files.unionByName(counts.select("dt", F.lit(None).cast("string").alias("file"), F.lit("row count differs").alias("problem")))
    wrong = _embedded_schema(spark, path, contract)
    return out.unionByName(spark.createDataFrame([(None, None, wrong)], "dt date, file string, problem string")) if wrong else out


def verify_landing(spark: SparkSession, root: str, manifest: DataFrame, table: str, day: date) -> DataFrame:
    """(dt, file, problem) of the day's landing files against the manifest; no row if all is well.

    A file may be missing, unknown or changed, written under another schema or not complete; the rows may be
    too many or too few, and the schema inside the files another than the declared one.
    """
    path = f"{root}/{table}/dt={day}"
    found = checksums(listed(spark, path), LEAF).select(F.regexp_extract("path", NAME, 0).alias("file"), F.col("sha256").alias("found"))
    mine = manifest.filter((F.col("table_name") == table) & (F.col("dt") == F.lit(day)))
    rows = read_landing(spark, root, CONTRACTS[table], day).agg(F.lit(day).alias("dt"), F.count(F.lit(1)).alias("n"))
    return _proof(spark, mine, found, rows, ["file"], path, table)


def verify_landing_days(spark: SparkSession, root: str, manifest: DataFrame, table: str) -> DataFrame:
    """``verify_landing`` over all days of the table; files of two days may bear one name."""
    path = f"{root}/{table}"
    found = _landing_files(spark, root, table).select("dt", "file", F.col("sha256").alias("found"))
    rows = spark.read.schema(f"{landing_schema(CONTRACTS[table])}, dt date").parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    return _proof(spark, manifest.filter(F.col("table_name") == table), found, rows, ["dt", "file"], path, table)


def list_partitions(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Days that have landing files; folders with other names are left out."""
    return listed(spark, f"{root}/{table}", recursive=True).select(F.expr(FOLDER).alias("dt")).filter("dt is not null").distinct()


def load_partition(spark: SparkSession, root: str, bronze: str, table: str, day: date, at: Column) -> int:
    """Replace exactly the day's partition of bronze by its landing rows; a row of another day is refused."""
    rows = read_landing(spark, root, CONTRACTS[table], day).withColumn("_loaded_at", at)
    checked = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_ingestion_date").eqNullSafe(F.lit(day))).alias("strange")).first()
    if checked["strange"]:
        raise ValueError(f"{checked['strange']} rows of {table} do not belong to {day}")
    rows.write.mode("overwrite").partitionBy("_ingestion_date").option("partitionOverwriteMode", "dynamic").parquet(f"{bronze}/{table}")
    return checked["n"]


def load_days(spark: SparkSession, root: str, bronze: str, table: str, at: Column, after: date) -> None:
    """``load_partition`` for every landing day after ``after`` in one job: exactly these partitions of bronze are replaced.

    Rows that do not belong to the day of their folder are refused.
    """
    rows = spark.read.schema(f"{landing_schema(CONTRACTS[table])}, dt date").parquet(f"{root}/{table}").filter(F.col("dt") > F.lit(after))
    if strange := rows.filter(~F.col("_ingestion_date").eqNullSafe(F.col("dt"))).count():
        raise ValueError(f"{strange} rows of {table} do not belong to the day of their folder")
    rows.drop("dt").withColumn("_loaded_at", at).write.mode("overwrite").partitionBy("_ingestion_date").option("partitionOverwriteMode", "dynamic").parquet(f"{bronze}/{table}")


def replay_all(spark: SparkSession, root: str, bronze: str, table: str, manifest: DataFrame, at: Column) -> int:
    """Build the whole bronze table anew from all landing days in one job; the count must be the manifest's."""
    rows = spark.read.schema(landing_schema(CONTRACTS[table])).parquet(f"{root}/{table}").drop("dt").withColumn("_loaded_at", at)
    wanted = manifest.filter(F.col("table_name") == table).select("dt", "parquet_rows").distinct().agg(F.sum("parquet_rows")).first()[0]
    found = rows.count()
    if wanted != found:
        raise ValueError(f"{table}: {found} rows instead of {wanted}")
    rows.write.mode("overwrite").partitionBy("_ingestion_date").parquet(f"{bronze}/{table}")
    return found


def write_table(df: DataFrame, path: str, partition: str, cluster: list[str]) -> None:
    """A partitioned table whose files are ordered by up to four columns, so that scans skip row groups."""
    if len(cluster) > 4:
        raise ValueError("at most four cluster columns")
    #: Ranges of the cluster columns, so that a large partition is not written by one task.
    df.repartitionByRange(partition, *cluster).sortWithinPartitions(partition, *cluster).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_colocated(frames: dict[str, DataFrame], key: str, buckets: int, path: str) -> dict[str, DataFrame]:
    """Tables that hold equal keys in equal buckets, ordered by the key, so that joins and sums by the key shuffle nothing.

    Each table is shuffled once, when it is written. Take as many buckets as make a bucket of the largest table fit a task.
    """
    out = {}
    for name, df in frames.items():
        table = f"{name}_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.format("parquet").option("path", f"{path}/{name}").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        out[name] = df.sparkSession.table(table)
    return out


def append_audit(events: DataFrame, path: str) -> None:
    """Append events; fields that an event does not have are null, but for REQUIRED ones."""
    if lacking := [c for c in REQUIRED if c not in events.columns]:
        raise ValueError(f"audit events lack {', '.join(lacking)}")
    kinds = dict(c.split(" ") for c in AUDIT.split(", "))
    events.select(*[(F.col(n) if n in events.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(path)


def audit_status(events: DataFrame) -> DataFrame:
    """Status of extract and load events from their counts, and whether it passes."""
    seen = F.count(F.when((F.col("event") == "load") & (F.col("bronze_rows") == F.col("parquet_rows")), 1)).over(
        Over.partitionBy("table_name", "dt").orderBy("recorded_at").rowsBetween(Over.unboundedPreceding, -1)
    )
    extracted = F.when(F.col("source_rows") == F.col("parquet_rows"), "extracted").otherwise("mismatch")
    loaded = F.when(F.col("bronze_rows") != F.col("parquet_rows"), "mismatch").when(seen > 0, "replayed").otherwise("loaded")
    status = F.when(F.col("event") == "extract", extracted).otherwise(loaded)
    return events.withColumn("status", status).withColumn("passed", F.col("status").isin("extracted", "loaded", "replayed"))


def check_continuity(manifest: DataFrame) -> DataFrame:
    """Days of the manifest whose day before is missing, but for the first of each table."""
    days = manifest.select("table_name", "dt").distinct()
    before = F.lag("dt").over(Over.partitionBy("table_name").orderBy("dt"))
    return days.withColumn("before", before).filter(F.datediff("dt", "before") > 1)


def plan_extract(manifest: DataFrame, wanted: DataFrame, force: bool = False) -> DataFrame:
    """(table_name, dt, action): replay what is complete, extract the rest; forced extracts only for the newest day."""
    complete = manifest.filter("status = 'complete'").select("table_name", "dt").distinct()
    newest = complete.groupBy("table_name").agg(F.max("dt").alias("newest"))
    joined = wanted.join(complete.withColumn("have", F.lit(True)), ["table_name", "dt"], "left").join(newest, "table_name", "left")
    forced = F.lit(force) & (F.col("dt") >= F.coalesce("newest", F.col("dt")))
    return joined.select("table_name", "dt", F.when(F.col("have").isNull() | forced, "extract").when(F.lit(force), "refuse").otherwise("replay").alias("action"))


def reconcile_local(manifest: DataFrame, audit: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """For each landed day the last load event that covers it, and whether it is good.

    ``problems`` is what ``verify_landing_days`` found; a day with one, or any day where one has no day, is not good.
    """
    last = audit.filter("event = 'load'").groupBy("table_name", "dt").agg(F.max_by("status", "recorded_at").alias("last_status"), F.max_by("bronze_rows", "recorded_at").alias("bronze_rows"))
    days = manifest.select("table_name", "dt", "parquet_rows").distinct()
    good = F.coalesce(F.col("last_status").isin("loaded", "replayed") & (F.col("bronze_rows") == F.col("parquet_rows")), F.lit(False))
    joined = days.join(last, ["table_name", "dt"], "left").withColumn("passed", good)
    if problems is None:
        return joined
    everywhere = problems.agg(F.count_if(F.col("dt").isNull()).alias("everywhere"))
    broken = problems.filter("dt is not null").groupBy(F.col("dt").alias("broken_day")).agg(F.count(F.lit(1)).alias("landing_problems"))
    proved = joined.join(broken, F.col("dt") == F.col("broken_day"), "left").drop("broken_day").join(F.broadcast(everywhere))
    problems_of_day = F.coalesce("landing_problems", F.lit(0)) + F.col("everywhere")
    return proved.withColumns({"landing_problems": problems_of_day, "passed": F.col("passed") & (problems_of_day == 0)}).drop("everywhere")


def reconcile_full(source: DataFrame, bronze: DataFrame, contract: Contract, cutoff: Column, by_ranges: bool = False) -> DataFrame:
    """One row: keys and newest change on both sides up to the cutoff, and the keys that only one side has.

    ``by_ranges`` finds these by digests of key ranges, so that only ranges that differ move their keys.
    """
    a, b = source.filter(F.col(contract.cursor) < cutoff), bronze.filter(F.col(contract.cursor) < cutoff)
    side = lambda df, name: df.agg(F.countDistinct(contract.key).alias(f"{name}_keys"), F.max(contract.cursor).alias(f"{name}_newest"))
    diff = (range_diff if by_ranges else set_diff)(a, b, contract.key).agg(F.count_if(F.col("side") == "left").alias("missing_in_bronze"), F.count_if(F.col("side") == "right").alias("missing_in_source"))
    joined = side(a, "source").join(F.broadcast(side(b, "bronze"))).join(F.broadcast(diff))
    same = (F.col("source_keys") == F.col("bronze_keys")) & F.col("source_newest").eqNullSafe(F.col("bronze_newest")) & (F.col("missing_in_bronze") == 0) & (F.col("missing_in_source") == 0)
    return joined.withColumn("passed", same)


def check_freshness(source: DataFrame, bronze: DataFrame, cursor: str) -> DataFrame:
    """One row: bronze must hold nothing newer than the source."""
    newest = source.agg(F.max(cursor).alias("source_newest")).join(F.broadcast(bronze.agg(F.max(cursor).alias("bronze_newest"))))
    return newest.withColumn("passed", F.coalesce(F.col("bronze_newest") <= F.col("source_newest"), F.lit(True)))

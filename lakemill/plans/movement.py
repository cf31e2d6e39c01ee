"""Queries that run ingestion, reconciliation, change capture and streaming over the source tables."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.columns import local_time
from lakemill.functions.lineage import settle, shared_folder
from lakemill.operators.history import snapshot_changes
from lakemill.operators.spine import dim_time
from lakemill.plans.counterpart import over_warehouse
from lakemill.plans.models import plain
from lakemill.plans.warehouse import warehouse
from lakemill.sources import coverage, ingest, ledger
from lakemill.sources.adapters import ZONE_HOURS, bronze, source
from lakemill.sources.contracts import CONTRACTS
from lakemill.sources.tables import read_table
from lakemill.sources.windows import day_window
from lakemill.streaming import jobs

DAY = date(1998, 6, 15)
WINDOW = day_window(DAY)
ORDERS = CONTRACTS["orders"]
SHOWN = ["order_id", "order_status", "updated_at"]
CUTOFF = "2000-01-01 00:00:00"
#: Bounds of the periods in which a stream gets the orders, and files of each.
PERIODS = ("0001-01-01", "1995-01-01", "1997-01-01", "9999-01-01")
FILES = 4
#: Buckets of the tables by order.
BUCKETS = 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can reach."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _orders(spark, sf_dir) -> DataFrame:
    return source(spark, sf_dir, "orders")


def incremental(spark, sf_dir):
    return ingest.extract(_orders(spark, sf_dir), ORDERS, WINDOW).select(*SHOWN)


def bootstrap(spark, sf_dir):
    return ingest.extract(_orders(spark, sf_dir), ORDERS, WINDOW, "bootstrap").select(*SHOWN)


def full(spark, sf_dir):
    return ingest.extract(source(spark, sf_dir, "areas"), CONTRACTS["areas"], WINDOW).select("area_id", "area_name")


def counts(spark, sf_dir):
    return ingest.window_counts(_orders(spark, sf_dir), "updated_at", WINDOW)


def _landed(spark, sf_dir, root: str) -> DataFrame:
    day = bronze(spark, sf_dir, "orders").filter(F.col("_ingestion_date") == F.lit(DAY)).drop("_ingestion_date")
    rows = ingest.with_extract_metadata(day, "batch-1", "incremental", F.lit(datetime(1998, 6, 16, 1)), "orders", DAY)
    ingest.write_landing(rows, root, ORDERS, DAY, ordered=True)
    return ingest.build_manifest(spark, root, "orders", DAY, "batch-1")


def _bronze(spark, target: str) -> DataFrame:
    return spark.read.schema(f"{ingest.landing_schema(ORDERS)}, _loaded_at timestamp_ntz").parquet(f"{target}/orders")


def landing_to_bronze(spark, sf_dir):
    """A day's landing files, verified, loaded twice into its bronze partition: rows come once."""
    root, target = scratch(spark, "landing"), scratch(spark, "bronze")
    manifest = _landed(spark, sf_dir, root)
    if ingest.verify_landing(spark, root, manifest, "orders", DAY).limit(1).count():
        raise ValueError("landing files do not match their manifest")
    for _ in range(2):
        ingest.load_partition(spark, root, target, "orders", DAY, F.lit(datetime(1998, 6, 16, 2)))
    return _bronze(spark, target).select(*SHOWN, "_ingestion_date")


def replayed_days(spark, sf_dir):
    """All days land, are verified, and the whole bronze table is built anew from them: rows by day."""
    root, target = scratch(spark, "landing"), scratch(spark, "bronze")
    at = F.col("_ingestion_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1), F.lit(1))
    rows = ingest.with_extract_metadata(bronze(spark, sf_dir, "orders"), "batch-1", "incremental", at, "orders", F.col("_ingestion_date"))
    ingest.write_landing_days(rows, root, ORDERS)
    manifest = settle(ingest.build_manifest_days(spark, root, "orders", rows, "batch-1"))
    if ingest.verify_landing_days(spark, root, manifest, "orders").limit(1).count():
        raise ValueError("landing files do not match their manifest")
    ingest.replay_all(spark, root, target, "orders", manifest, F.lit(datetime(1998, 6, 16, 2)))
    days = ingest.list_partitions(spark, root, "orders")
    return _bronze(spark, target).groupBy("_ingestion_date").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(days), F.col("_ingestion_date") == F.col("dt"), "left_semi")


def replayed(spark, sf_dir):
    """The same rebuild of the whole table; its counterpart shows one day of it."""
    return replayed_days(spark, sf_dir).filter(F.col("_ingestion_date") == F.lit(DAY))


def _days(spark, sf_dir) -> DataFrame:
    """A manifest in small: the days on which orders were ingested."""
    return bronze(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("table_name"), F.col("_ingestion_date").alias("dt")).agg(F.count(F.lit(1)).alias("parquet_rows")).withColumn("status", F.lit("complete"))


def continuity(spark, sf_dir):
    return ingest.check_continuity(_days(spark, sf_dir))


def extract_plan(spark, sf_dir):
    """Every other day is complete; all days are asked for."""
    days = _days(spark, sf_dir)
    return ingest.plan_extract(days.filter("day(dt) % 2 = 0"), days.select("table_name", "dt"))


def _events(spark, sf_dir) -> DataFrame:
    """Extract and load events from the days: a few loads lose a row, and days before 1996 are loaded again."""
    days = _days(spark, sf_dir).withColumns({"source_rows": F.col("parquet_rows"), "bronze_rows": F.col("parquet_rows") - F.when(F.dayofyear("dt") == 100, 1).otherwise(0)})
    at = lambda hours: (F.col("dt").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1), F.lit(hours))).alias("recorded_at")
    columns = ["table_name", "dt", "source_rows", "parquet_rows", "bronze_rows"]
    kinds = [days.select(F.lit("extract").alias("event"), *columns, at(1)), days.select(F.lit("load").alias("event"), *columns, at(2)), days.filter("year(dt) < 1996").select(F.lit("load").alias("event"), *columns, at(3))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def audit(spark, sf_dir):
    return ingest.audit_status(_events(spark, sf_dir)).groupBy("event", "status", "passed").agg(F.count(F.lit(1)).alias("events"))


def appended_audit(spark, sf_dir):
    """Extract and load events appended to an audit table in two writes, and read from it again."""
    path = scratch(spark, "audit")
    events = ingest.audit_status(_events(spark, sf_dir)).withColumns({"run_mode": F.lit("incremental"), "started_at": F.col("recorded_at"), "finished_at": F.col("recorded_at"), "duration_s": F.lit(0.0)})
    for event in ("extract", "load"):
        ingest.append_audit(events.filter(F.col("event") == event), path)
    return ingest.read_audit(spark, path).groupBy("event", "status").agg(F.count(F.lit(1)).alias("events"), F.sum("parquet_rows").alias("rows"))


def clustered_table(spark, sf_dir):
    """Orders in a table that is partitioned by status and ordered by store and day, read again."""
    path = scratch(spark, "clustered")
    ingest.write_table(_orders(spark, sf_dir), path, "order_status", ["store_id", "order_ts"])
    return spark.read.parquet(path).groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"), F.min("store_id").alias("first_store"), F.max("order_ts").alias("last_order"))


def colocated(spark, sf_dir) -> DataFrame:
    """Each order with its lines and payments, from tables in buckets by the order: nothing is shuffled."""
    latest = warehouse(spark, sf_dir).latest
    frames = {"orders": latest("orders").select("order_id", "order_status", "total_amount"), "lines": latest("order_items").select("order_id", "quantity", "line_total"), "payments": latest("payments").select("order_id", "payment_status", "amount")}
    tables = ingest.write_colocated(frames, "order_id", BUCKETS, scratch(spark, "colocated"))
    lines = tables["lines"].groupBy(F.col("order_id").alias("l")).agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.sum("line_total").alias("line_total"))
    paid = tables["payments"].groupBy(F.col("order_id").alias("p")).agg(F.count(F.lit(1)).alias("payments"), F.sum(F.when(F.col("payment_status") == "paid", F.col("amount"))).alias("paid"))
    joined = tables["orders"].hint("merge").join(lines.hint("merge"), F.col("order_id") == F.col("l"), "left").join(paid.hint("merge"), F.col("order_id") == F.col("p"), "left")
    return joined.select("order_id", "order_status", "total_amount", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "units", "line_total", "payments", "paid")])


def local_reconcile(spark, sf_dir):
    return ingest.reconcile_local(_days(spark, sf_dir), ingest.audit_status(_events(spark, sf_dir))).groupBy("last_status", "passed").agg(F.count(F.lit(1)).alias("days"))


def covered_reconcile(spark, sf_dir):
    """All days of the stores land, are proved and loaded a day each; those up to DAY had come in a replay of everything.

    The events hold what each job really did: the manifest's counts, and the rows that stand in bronze after it.
    """
    table, root, target = "stores", scratch(spark, "landing"), scratch(spark, "bronze")
    contract, days = CONTRACTS[table], bronze(spark, sf_dir, table)
    at = lambda hours: F.col("dt").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1), F.lit(hours))
    early, late = days.filter(F.col("_ingestion_date") <= F.lit(DAY)), days.filter(F.col("_ingestion_date") > F.lit(DAY))
    land = lambda rows: ingest.write_landing_days(ingest.with_extract_metadata(rows, "batch", "incremental", F.lit(datetime(1999, 1, 1)), table, F.col("_ingestion_date")), root, contract, "append")
    land(early)
    first, moment = settle(ingest.build_manifest_days(spark, root, table, early, "batch", started=at(0), finished=at(1))), F.lit(datetime(1998, 6, 16, 2))
    rows = F.lit(ingest.replay_all(spark, root, target, table, first, moment))
    replay = first.agg(*coverage.coverage(first)).withColumns({"table_name": F.lit(table), "load_batch_id": F.lit("replay-1"), "run_mode": F.lit(coverage.REPLAY), "status": F.lit("replayed"), "dt": F.lit(DAY)})
    replay = replay.withColumns({"parquet_rows": rows, "bronze_rows": rows, "started_at": moment})
    land(late)
    own = F.concat_ws("-", "table_name", "dt")
    manifest = settle(ingest.build_manifest_days(spark, root, table, days, "batch", started=at(0), finished=at(1)).withColumn("batch_id", own))
    ingest.load_days(spark, root, target, table, F.lit(datetime(1999, 1, 2)), after=DAY)
    held = spark.read.parquet(f"{target}/{table}").groupBy(F.col("_ingestion_date").alias("d")).agg(F.count(F.lit(1)).alias("bronze_rows"))
    loads = coverage.artifacts(manifest).filter(F.col("dt") > F.lit(DAY)).join(held, F.col("dt") == F.col("d"), "left").withColumns({"started_at": at(2), "load_batch_id": F.concat(F.lit("load-"), "dt")})
    loads = loads.select("table_name", "dt", F.col("batch_id").alias("extract_batch_id"), "load_batch_id", F.lit("load").alias("run_mode"), "started_at", "parquet_rows", "bronze_rows", F.when(F.col("bronze_rows") == F.col("parquet_rows"), "loaded").otherwise("mismatch").alias("status"))
    path = scratch(spark, "audit")
    for events in (replay, loads):
        ingest.append_audit(events.withColumns({"event": F.lit("load"), "finished_at": F.col("started_at"), "duration_s": F.lit(0.0)}), path)
    problems = ingest.verify_landing_days(spark, root, manifest, table).select(F.lit(table).alias("table_name"), "dt", "problem")
    return coverage.reconcile_covered(manifest, ingest.read_audit(spark, path), problems).drop("batch_id")


def load_replays(spark, sf_dir):
    """Loads of the orders' days by what covered them before. The days of 1994 were first loaded on 1 January 1996, but a replay of
    all days up to then had come on 1 June 1995."""
    batch, second = F.concat_ws("-", "table_name", "dt"), F.lit(datetime(1996, 1, 1))
    window = {"window_start": F.col("dt").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(ZONE_HOURS))}
    window["window_end"] = window["window_start"] + F.make_dt_interval(F.lit(1))
    ended = F.col("dt").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1), F.lit(1))
    known = _days(spark, sf_dir).withColumns({"batch_id": batch, "source_rows": F.col("parquet_rows"), "finished_at": ended, **window})
    loads = _events(spark, sf_dir).filter("event = 'load'")
    late = loads.filter("year(dt) = 1994 and recorded_at = cast(dt as timestamp_ntz) + make_dt_interval(1, 2)").withColumn("recorded_at", second)
    own = loads.filter("year(dt) <> 1994").unionByName(late).withColumns({"extract_batch_id": batch, "load_batch_id": F.concat_ws("-", "table_name", "dt", "recorded_at"), "run_mode": F.lit("load")})
    own = own.withColumns({"started_at": F.col("recorded_at"), "finished_at": F.col("recorded_at"), "status": F.lit(None).cast("string")})
    begun = F.lit(datetime(1995, 6, 1))
    replay = known.filter("year(dt) <= 1994").agg(*coverage.coverage(known)).withColumns({"table_name": F.lit("orders"), "load_batch_id": F.lit("replay-1"), "run_mode": F.lit(coverage.REPLAY), "status": F.lit("replayed"), "started_at": begun, "finished_at": begun})
    audit = own.unionByName(replay, allowMissingColumns=True)
    return coverage.load_statuses(known, audit).groupBy("status").agg(F.count(F.lit(1)).alias("loads"), F.sum("bronze_rows").alias("rows"), F.max("dt").alias("last_day"))


def full_reconcile(spark, sf_dir):
    """Bronze without every hundredth key against the source."""
    held = bronze(spark, sf_dir, "orders").filter("order_id % 100 <> 1")
    return ingest.reconcile_full(_orders(spark, sf_dir), held, ORDERS, F.lit(CUTOFF).cast("timestamp_ntz"))


def untouched_reconcile(spark, sf_dir):
    """All of bronze against the source."""
    return ingest.reconcile_full(_orders(spark, sf_dir), bronze(spark, sf_dir, "orders"), ORDERS, F.lit(CUTOFF).cast("timestamp_ntz"))


def ranges_reconcile(spark, sf_dir):
    """The same by digests of key ranges: a table that agrees moves no keys."""
    return ingest.reconcile_full(_orders(spark, sf_dir), bronze(spark, sf_dir, "orders"), ORDERS, F.lit(CUTOFF).cast("timestamp_ntz"), by_ranges=True)


def freshness(spark, sf_dir):
    return ingest.check_freshness(_orders(spark, sf_dir), bronze(spark, sf_dir, "orders"), "updated_at")


def changes(spark, sf_dir):
    """Customers before and after: the later version against the first, repeats left out."""
    versions = source(spark, sf_dir, "customers")
    first, second = versions.filter("updated_at < '1995-01-01'"), versions.filter("updated_at >= '1995-01-01'")
    same = second.withColumn("updated_at", F.lit("1994-12-01 00:00:00").cast("timestamp_ntz"))
    return snapshot_changes(first, same, "customer_id", "updated_at", F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).select("customer_id", "loyalty_tier", "updated_at")


def minutes(spark, sf_dir):
    """Orders by the time dimension's part of the day."""
    orders = _orders(spark, sf_dir).withColumn("time_key", (F.hour(local_time("order_ts")) * 60 + F.minute(local_time("order_ts"))).cast("long"))
    return orders.join(F.broadcast(dim_time(spark)), "time_key").groupBy("daypart").agg(F.count(F.lit(1)).alias("orders"), F.min("time_label").alias("first_minute"), F.max("time_value").alias("last_minute"))


def all_minutes(spark, sf_dir):
    """Every row of the time dimension, with the orders of its minute."""
    orders = _orders(spark, sf_dir).groupBy((F.hour(local_time("order_ts")) * 60 + F.minute(local_time("order_ts"))).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return dim_time(spark).join(F.broadcast(orders), F.col("time_key") == F.col("at"), "left").withColumn("orders", F.coalesce("n", F.lit(0))).drop("at", "n")


def _staged(spark, sf_dir, table: str) -> str:
    """The table as files for a stream to find."""
    path = scratch(spark, "incoming")
    rows = bronze(spark, sf_dir, table).withColumn("updated_at", F.to_timestamp(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    rows.repartition(4, CONTRACTS[table].key).write.parquet(path)
    return path


def stream_bronze(spark, sf_dir):
    """Stores' landing files, two a batch, through a stream that replaces bronze days: most days come over several batches."""
    path, target = _staged(spark, sf_dir, "stores"), scratch(spark, "stream-bronze")
    landed = spark.read.parquet(path)
    jobs.bronze_stream(jobs.stream_landing(spark, landed.schema, path, files_a_batch=2), target, scratch(spark, "stream-progress")).awaitTermination()
    return ledger.read_days(spark, target, ledger.ddl(landed)).groupBy("_ingestion_date").agg(F.count(F.lit(1)).alias("rows"))


def stream_without_replays(spark, sf_dir):
    """Order versions in the order of their ingestion, a period a batch: a replay copy comes a day later at most,
    so a lookback of two days finds it, in the same batch or in the next, and older state is given up."""
    path = scratch(spark, "incoming")
    rows = bronze(spark, sf_dir, "orders").withColumn("updated_at", F.to_timestamp(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    for low, high in zip(PERIODS, PERIODS[1:]):
        rows.filter(f"_ingestion_date >= date'{low}' and _ingestion_date < date'{high}'").repartition(FILES).write.mode("append").parquet(path)
    stream = jobs.stream_landing(spark, spark.read.parquet(path).schema, path, files_a_batch=FILES)
    kept = jobs.without_replays(stream, "order_id", "updated_at", "2 days")
    rows = jobs.run_to_files(kept.select("order_id", "order_status"), scratch(spark, "kept"), scratch(spark, "kept-progress"))
    return rows.groupBy("order_status").agg(F.count(F.lit(1)).alias("versions"))


def stream_day_counts(spark, sf_dir):
    """Events by business day, through a stream over the events table."""
    path = scratch(spark, "events")
    read_table(spark, sf_dir, "events").select("event_id", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts")).repartition(4).write.parquet(path)
    stream = jobs.stream_landing(spark, spark.read.parquet(path).schema, path)
    counted = jobs.run_to_totals(jobs.business_day_counts(stream, "ts"), scratch(spark, "days"), scratch(spark, "days-progress"))
    day = F.to_date(F.date_format(F.expr(f"window.start + make_dt_interval(0, {ZONE_HOURS})"), "yyyy-MM-dd"))
    return counted.select(day.alias("business_date"), "events")


QUERIES = {
    "ing2_incremental": incremental, "ing3_bootstrap": bootstrap, "ing4_full": full, "ing5_counts": counts, "snk5_landing_to_bronze": landing_to_bronze, "snk6_replayed": replayed, "snk6_replayed_days": replayed_days, "ing8_continuity": continuity,
    "ing11_plan": extract_plan, "snk8_clustered": clustered_table, "snk9_audit": appended_audit, "rec1_audit": audit, "rec2_local": local_reconcile, "snk8_colocated": colocated, "rec2_covered": covered_reconcile, "rec5_load_statuses": load_replays, "rec3_full": full_reconcile, "rec3_untouched": untouched_reconcile, "rec3_ranges": ranges_reconcile, "rec4_freshness": freshness, "cdc1_changes": changes, "spn3_dayparts": minutes, "spn3_minutes": all_minutes,
    "str1_bronze": stream_bronze, "str2_without_replays": stream_without_replays, "str3_day_counts": stream_day_counts,
}

_START, _END = WINDOW.start, WINDOW.end
_LOW = _START - WINDOW.lookback
_DAYS = "dy AS (SELECT _ingestion_date AS dt, count(*) AS n FROM b_orders GROUP BY 1)"
SQL = {
    "ing2_incremental": over_warehouse(f"SELECT order_id, order_status, updated_at FROM v_orders WHERE updated_at >= TIMESTAMP '{_LOW}' AND updated_at < TIMESTAMP '{_END}'"),
    "ing3_bootstrap": over_warehouse(f"SELECT order_id, order_status, updated_at FROM v_orders WHERE updated_at < TIMESTAMP '{_END}'"),
    "ing4_full": over_warehouse("SELECT area_id, area_name FROM s_areas"),
    "ing5_counts": over_warehouse(f"SELECT count(*) AS source_rows, count(*) FILTER (updated_at >= TIMESTAMP '{_START}') AS rows_in_window, count(*) FILTER (updated_at < TIMESTAMP '{_START}') AS rows_in_lookback FROM v_orders WHERE updated_at >= TIMESTAMP '{_LOW}' AND updated_at < TIMESTAMP '{_END}'"),
    "snk5_landing_to_bronze": over_warehouse(f"SELECT order_id, order_status, updated_at, _ingestion_date FROM b_orders WHERE _ingestion_date = DATE '{DAY}'"),
    "snk6_replayed": over_warehouse(f"SELECT _ingestion_date, count(*) AS rows FROM b_orders WHERE _ingestion_date = DATE '{DAY}' GROUP BY 1"),
    "snk6_replayed_days": over_warehouse("SELECT _ingestion_date, count(*) AS rows FROM b_orders GROUP BY 1"),
    "ing8_continuity": over_warehouse(f", {_DAYS}, g AS (SELECT 'orders' AS table_name, dt, lag(dt) OVER (ORDER BY dt) AS before FROM dy) SELECT * FROM g WHERE dt - before > 1"),
    "ing11_plan": over_warehouse(f", {_DAYS} SELECT 'orders' AS table_name, dt, CASE WHEN day(dt) % 2 = 0 THEN 'replay' ELSE 'extract' END AS action FROM dy"),
    "rec1_audit": over_warehouse(f", {_DAYS}, e AS (SELECT 'extract' AS event, 'extracted' AS status FROM dy UNION ALL SELECT 'load', CASE WHEN dayofyear(dt) = 100 THEN 'mismatch' ELSE 'loaded' END FROM dy UNION ALL SELECT 'load', CASE WHEN dayofyear(dt) = 100 THEN 'mismatch' ELSE 'replayed' END FROM dy WHERE year(dt) < 1996) SELECT event, status, status <> 'mismatch' AS passed, count(*) AS events FROM e GROUP BY ALL"),
    "snk8_clustered": over_warehouse("SELECT order_status, count(*) AS orders, min(store_id) AS first_store, max(order_ts) AS last_order FROM v_orders GROUP BY 1"),
    "snk9_audit": over_warehouse(f", {_DAYS}, e AS (SELECT 'extract' AS event, 'extracted' AS status, n FROM dy UNION ALL SELECT 'load', CASE WHEN dayofyear(dt) = 100 THEN 'mismatch' ELSE 'loaded' END, n FROM dy UNION ALL SELECT 'load', CASE WHEN dayofyear(dt) = 100 THEN 'mismatch' ELSE 'replayed' END, n FROM dy WHERE year(dt) < 1996) SELECT event, status, count(*) AS events, sum(n)::BIGINT AS rows FROM e GROUP BY ALL"),
    "rec2_local": over_warehouse(f", {_DAYS}, e AS (SELECT CASE WHEN dayofyear(dt) = 100 THEN 'mismatch' WHEN year(dt) < 1996 THEN 'replayed' ELSE 'loaded' END AS last_status FROM dy) SELECT last_status, last_status <> 'mismatch' AS passed, count(*) AS days FROM e GROUP BY ALL"),
    "snk8_colocated": over_warehouse(", l AS (SELECT order_id, count(*) AS lines, sum(quantity)::BIGINT AS units, sum(line_total) AS line_total FROM l_order_items GROUP BY 1), p AS (SELECT order_id, count(*) AS payments, sum(amount) FILTER (payment_status = 'paid') AS paid FROM l_payments GROUP BY 1) SELECT order_id, order_status, total_amount::DOUBLE AS total_amount, coalesce(lines, 0) AS lines, coalesce(units, 0) AS units, coalesce(line_total, 0)::DOUBLE AS line_total, coalesce(payments, 0) AS payments, coalesce(paid, 0)::DOUBLE AS paid FROM l_orders LEFT JOIN l USING (order_id) LEFT JOIN p USING (order_id)"),
    "rec2_covered": over_warehouse(f", d AS (SELECT _ingestion_date AS dt, count(*) AS n FROM b_stores GROUP BY 1) SELECT 'stores' AS table_name, dt, n AS source_rows, n AS parquet_rows, 0::BIGINT AS landing_problems, CASE WHEN dt <= DATE '{DAY}' THEN 'replay_all' ELSE 'load' END AS last_mode, CASE WHEN dt <= DATE '{DAY}' THEN 'replay-1' ELSE 'load-' || dt END AS last_load, CASE WHEN dt <= DATE '{DAY}' THEN 'replayed' ELSE 'loaded' END AS last_status, CASE WHEN dt <= DATE '{DAY}' THEN (SELECT count(*) FROM b_stores WHERE _ingestion_date <= DATE '{DAY}') ELSE n END AS last_rows, true AS passed FROM d"),
    "rec5_load_statuses": over_warehouse(f""", {_DAYS}, e AS (SELECT dt, n - CASE WHEN dayofyear(dt) = 100 THEN 1 ELSE 0 END AS b, dayofyear(dt) = 100 AS wrong FROM dy),
  l AS (SELECT dt, b, CASE WHEN wrong THEN 'mismatch' WHEN year(dt) = 1994 THEN 'replayed' ELSE 'loaded' END AS status FROM e
  UNION ALL SELECT dt, b, CASE WHEN wrong THEN 'mismatch' ELSE 'replayed' END FROM e WHERE year(dt) < 1996 AND year(dt) <> 1994)
  SELECT status, count(*) AS loads, sum(b)::BIGINT AS rows, max(dt) AS last_day FROM l GROUP BY 1"""),
    "rec3_full": over_warehouse(f", a AS (SELECT * FROM v_orders WHERE updated_at < TIMESTAMP '{CUTOFF}'), b AS (SELECT * FROM b_orders WHERE updated_at < TIMESTAMP '{CUTOFF}' AND order_id % 100 <> 1) SELECT (SELECT count(DISTINCT order_id) FROM a) AS source_keys, (SELECT max(updated_at) FROM a) AS source_newest, (SELECT count(DISTINCT order_id) FROM b) AS bronze_keys, (SELECT max(updated_at) FROM b) AS bronze_newest, (SELECT count(DISTINCT order_id) FROM a WHERE order_id NOT IN (SELECT order_id FROM b)) AS missing_in_bronze, 0::BIGINT AS missing_in_source, (SELECT count(DISTINCT order_id) FROM a WHERE order_id NOT IN (SELECT order_id FROM b)) = 0 AS passed"),
    "rec4_freshness": over_warehouse("SELECT max(updated_at) AS source_newest, max(updated_at) AS bronze_newest, true AS passed FROM v_orders"),
    "cdc1_changes": over_warehouse("SELECT customer_id, loyalty_tier, TIMESTAMP '1999-01-01' AS updated_at FROM v_customers WHERE updated_at >= TIMESTAMP '1995-01-01' AND loyalty_tier <> 'basic'"),
    "spn3_dayparts": over_warehouse(f", t AS (SELECT hour(order_ts + INTERVAL {ZONE_HOURS} HOUR) AS h, strftime(order_ts + INTERVAL {ZONE_HOURS} HOUR, '%H:%M') AS m FROM v_orders) SELECT CASE WHEN h BETWEEN 5 AND 10 THEN 'Morning' WHEN h BETWEEN 11 AND 13 THEN 'Lunch' WHEN h BETWEEN 14 AND 16 THEN 'Afternoon' WHEN h BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Late Night' END AS daypart, count(*) AS orders, min(m) AS first_minute, max(m) || ':00' AS last_minute FROM t GROUP BY 1"),
    "spn3_minutes": over_warehouse(f", n AS (SELECT hour(order_ts + INTERVAL {ZONE_HOURS} HOUR) * 60 + minute(order_ts + INTERVAL {ZONE_HOURS} HOUR) AS k, count(*) AS orders FROM v_orders GROUP BY 1), m AS (SELECT k, k // 60 AS h, k % 60 AS i, printf('%02d:%02d', k // 60, k % 60) AS label FROM range(1440) r(k)) SELECT m.k AS time_key, h AS hour_24, i AS minute, label || ':00' AS time_value, label AS time_label, CASE WHEN h BETWEEN 5 AND 10 THEN 'Morning' WHEN h BETWEEN 11 AND 13 THEN 'Lunch' WHEN h BETWEEN 14 AND 16 THEN 'Afternoon' WHEN h BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Late Night' END AS daypart, coalesce(orders, 0) AS orders FROM m LEFT JOIN n USING (k)"),
    "str1_bronze": over_warehouse("SELECT _ingestion_date, count(*) AS rows FROM b_stores GROUP BY 1"),
    "str2_without_replays": over_warehouse("SELECT order_status, count(*) AS versions FROM s_orders GROUP BY 1"),
    "str3_day_counts": f"SELECT (ts + INTERVAL {ZONE_HOURS} HOUR)::DATE AS business_date, count(*) AS events FROM events GROUP BY 1",
}
SQL["rec3_ranges"] = SQL["rec3_untouched"] = SQL["rec3_full"].replace(" AND order_id % 100 <> 1", "")


def queries() -> dict:
    return {name: (lambda spark, sf_dir, q=q: plain(q(spark, sf_dir))) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

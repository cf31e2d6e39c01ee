from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakemill.sources import ingest
from lakemill.sources.contracts import CONTRACTS, conform, drift
from lakemill.sources.tables import read_source
from lakemill.sources.windows import business_date, day_window, effective_mode, ensure_closed

DAY = date(2026, 1, 2)
PAYMENTS = CONTRACTS["payments"]


def payments(spark, times):
    rows = [(i, i, "cash", "1.00", "paid", t, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "payment_id long, order_id long, payment_method string, amount string, payment_status string, paid_at timestamp_ntz, updated_at timestamp_ntz")
    return df.withColumn("amount", F.col("amount").cast("decimal(12,2)"))


def test_window_edges(spark):
    w = day_window(DAY)
    assert (w.start, w.end) == (datetime(2026, 1, 1, 16), datetime(2026, 1, 2, 16))
    tick = timedelta(microseconds=1)
    df = payments(spark, [w.end, w.end - tick, w.start - timedelta(minutes=60), w.start - timedelta(minutes=61)])
    assert sorted(r["payment_id"] for r in ingest.extract(df, PAYMENTS, w).collect()) == [1, 2]
    assert sorted(r["payment_id"] for r in ingest.extract(df, PAYMENTS, w, "bootstrap").collect()) == [1, 2, 3]
    counts = ingest.window_counts(df, "updated_at", w).first()
    assert (counts["source_rows"], counts["rows_in_window"], counts["rows_in_lookback"]) == (2, 1, 1)
    assert effective_mode(None, "incremental") == "full"


def test_guards():
    w = day_window(DAY)
    ensure_closed(w, datetime(2026, 1, 2, 16, 5, tzinfo=timezone.utc))
    with pytest.raises(ValueError):
        ensure_closed(w, datetime(2026, 1, 2, 16, 4, tzinfo=timezone.utc))
    with pytest.raises(ValueError):
        ensure_closed(w, datetime(2026, 1, 3))
    assert business_date(w.start, w.end) == DAY
    with pytest.raises(ValueError):
        business_date(w.start, w.end + timedelta(hours=1))


def test_drift_names_every_difference(spark):
    wrong = spark.sql("select 1 area_id, cast(1 as smallint) region_id, 2 extra")
    assert drift(wrong, CONTRACTS["areas"]) == ["missing area_name", "unexpected extra"]
    with pytest.raises(ValueError, match="missing area_name; unexpected extra"):
        conform(wrong, CONTRACTS["areas"])
    widened = conform(wrong.drop("extra").withColumn("area_name", F.lit("x")), CONTRACTS["areas"])
    assert dict(widened.dtypes)["region_id"] == "bigint"


def landed(spark, root, times, day=DAY):
    rows = ingest.with_extract_metadata(payments(spark, times), "b", "incremental", F.lit(datetime(2026, 1, 3)), "payments", day)
    ingest.write_landing(rows, root, PAYMENTS, day)
    return ingest.build_manifest(spark, root, "payments", day, "b")


def test_landing_replay_and_tampering(spark, tmp_path):
    root, bronze = f"file://{tmp_path}/landing", f"file://{tmp_path}/bronze"
    manifest = landed(spark, root, [datetime(2026, 1, 2)] * 3).cache()
    manifest.count()
    assert ingest.verify_landing(spark, root, manifest, "payments", DAY).count() == 0
    for _ in range(2):
        assert ingest.load_partition(spark, root, bronze, "payments", DAY, F.lit(datetime(2026, 1, 3))) == 3
    assert spark.read.parquet(f"{bronze}/payments").count() == 3
    other = date(2026, 1, 3)
    both = manifest.unionByName(landed(spark, root, [datetime(2026, 1, 3)] * 4, other))
    assert ingest.replay_all(spark, root, bronze, "payments", both, F.lit(datetime(2026, 1, 4))) == 7
    assert {str(r["dt"]) for r in ingest.list_partitions(spark, root, "payments").collect()} == {"2026-01-02", "2026-01-03"}
    file = next(Path(f"{tmp_path}/landing/payments/dt={DAY}").glob("*.parquet"))
    content = bytearray(file.read_bytes())
    content[10] ^= 1
    file.write_bytes(bytes(content))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert ingest.verify_landing(spark, root, manifest, "payments", DAY).count() == 1


def test_the_manifest_has_all_fields_and_proves_rows_schema_and_status(spark, tmp_path):
    root = f"file://{tmp_path}/landing"
    w = day_window(DAY)
    landed(spark, root, [w.start, w.start - timedelta(minutes=5), w.start + timedelta(hours=1)])
    at = lambda s: F.lit(datetime(2026, 1, 3, 0, 0, s))
    manifest = ingest.build_manifest(spark, root, "payments", DAY, "b", source_rows=4, started=at(1), finished=at(3))
    #: The rows themselves: a cached frame is read again when its files change.
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    row = manifest.first()
    assert len(manifest.columns) == 23 and row["duration_s"] == 2.0 and row["extract_mode"] == "incremental"
    assert (row["source_rows"], row["parquet_rows"], row["rows_in_window"], row["rows_in_lookback"]) == (4, 3, 2, 1)
    assert (row["window_start"], row["window_end"], row["extract_lower"]) == (w.start, w.end, w.start - w.lookback)
    problems = lambda m: {r["problem"] for r in ingest.verify_landing(spark, root, m, "payments", DAY).collect()}
    assert problems(manifest) == set()
    assert problems(manifest.withColumn("parquet_rows", F.lit(9))) == {"row count differs"}
    assert problems(manifest.withColumn("schema_hash", F.lit("x"))) == {"schema changed since the extract"}
    assert problems(manifest.withColumn("status", F.lit("started"))) == {"not complete"}
    assert problems(manifest.withColumn("file", F.lit("gone.parquet"))) == {"missing file", "unknown file"}
    spark.range(3).selectExpr("id as payment_id").write.mode("overwrite").parquet(f"{root}/payments/dt={DAY}")
    assert "embedded schema differs" in problems(manifest)


def test_a_day_with_a_landing_problem_is_not_reconciled(spark):
    day, other = DAY, date(2026, 1, 3)
    manifest = spark.createDataFrame([("payments", day, 3), ("payments", other, 4)], "table_name string, dt date, parquet_rows long")
    loads = spark.createDataFrame([("load", "payments", d, "loaded", n, datetime(2026, 1, 4)) for d, n in ((day, 3), (other, 4))], "event string, table_name string, dt date, status string, bronze_rows long, recorded_at timestamp_ntz")
    problems = spark.createDataFrame([(other, "f", "changed file")], "dt date, file string, problem string")
    passed = lambda p: {r["dt"]: r["passed"] for r in ingest.reconcile_local(manifest, loads, p).collect()}
    assert passed(None) == {day: True, other: True} and passed(problems) == {day: True, other: False}
    assert passed(problems.withColumn("dt", F.lit(None).cast("date"))) == {day: False, other: False}


def test_audit_fields_and_table_layout(spark, tmp_path):
    assert len(ingest.AUDIT.split(", ")) == 25
    with pytest.raises(ValueError, match="lack event"):
        ingest.append_audit(spark.range(1), f"{tmp_path}/audit")
    with pytest.raises(ValueError, match="four"):
        ingest.write_table(spark.range(1), f"{tmp_path}/t", "id", list("abcde"))


def test_a_source_is_read_under_its_declared_schema(spark, tmp_path):
    payments(spark, [datetime(2026, 1, 2)]).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/payments")
    read = read_source(spark, f"{tmp_path}/payments", PAYMENTS)
    assert read.columns == list(PAYMENTS.fields) and read.count() == 1


def test_rows_of_another_day_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/landing"
    rows = ingest.with_extract_metadata(payments(spark, [datetime(2026, 1, 2)]), "b", "incremental", F.lit(datetime(2026, 1, 3)), "payments", date(2026, 1, 9))
    ingest.write_landing(rows, root, PAYMENTS, DAY)
    with pytest.raises(ValueError, match="do not belong"):
        ingest.load_partition(spark, root, f"file://{tmp_path}/bronze", "payments", DAY, F.lit(datetime(2026, 1, 3)))


def test_empty_partition_keeps_its_schema(spark, tmp_path):
    root = f"file://{tmp_path}/landing"
    landed(spark, root, [])
    read = ingest.read_landing(spark, root, PAYMENTS, DAY)
    assert read.count() == 0 and dict(read.dtypes)["amount"] == "decimal(12,2)"

from __future__ import annotations

from lakemill.plans import movement
from lakemill.streaming import jobs
from tests.comparing import SF


def test_versions_of_the_stream_never_stand_on_the_driver(spark):
    plan = movement.queries()["str2_without_replays"](spark, SF)._jdf.queryExecution().toString()
    assert "MemoryPlan" not in plan and "LocalTableScan" not in plan and "FileScan parquet" in plan
    assert not [q for q in spark.catalog.listTables() if q.name.startswith("kept_")]


def test_files_of_a_stream_hold_each_version_once(spark, tmp_path):
    incoming = f"{tmp_path}/incoming"
    rows = [(i % 40, f"2026-01-0{i % 3 + 1} 00:00:00") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, at string").selectExpr("id", "cast(at as timestamp) as at")
    df.repartition(3).write.parquet(incoming)
    stream = jobs.without_replays(jobs.stream_landing(spark, df.schema, incoming, files_a_batch=1), "id", "at", "1000 days")
    got = jobs.run_to_files(stream, f"{tmp_path}/kept", f"{tmp_path}/progress")
    assert got.columns == ["id", "at"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.distinct().collect()))


def test_a_copy_within_the_lookback_goes_and_one_long_after_is_late(spark, tmp_path):
    incoming = f"{tmp_path}/incoming"
    at = lambda rows: spark.createDataFrame(rows, "id long, at string").selectExpr("id", "cast(at as timestamp) as at").coalesce(1).write.mode("append").parquet(incoming)
    for rows in ([(1, "2026-01-01 00:00:00")], [(1, "2026-01-01 00:00:00"), (2, "2026-01-02 00:00:00")], [(3, "2026-02-01 00:00:00")], [(1, "2026-01-01 00:00:00"), (4, "2026-02-01 12:00:00")]):
        at(rows)
    stream = jobs.stream_landing(spark, spark.read.parquet(incoming).schema, incoming, files_a_batch=1)
    got = jobs.run_to_files(jobs.without_replays(stream, "id", "at", "2 days"), f"{tmp_path}/kept", f"{tmp_path}/progress")
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4]


def test_a_stream_without_files_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = jobs.stream_landing(spark, spark.range(1).schema, f"{tmp_path}/none")
    assert jobs.run_to_files(stream, f"{tmp_path}/kept", f"{tmp_path}/progress").count() == 0

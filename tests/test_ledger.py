"""Bronze days under batches that come twice, die halfway or bring a day again."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakemill.sources import ledger
from lakemill.streaming import jobs

SCHEMA = "id long, _extract_batch_id string, _extracted_at timestamp_ntz, _ingestion_date date"
DAYS = [date(2026, 1, 1), date(2026, 1, 2)]


def rows(spark, ids, day, extract="e1", at=1):
    return spark.createDataFrame([(i, extract, datetime(2026, 2, at), day) for i in ids], SCHEMA)


def held(spark, bronze):
    return Counter((r["id"], r["_ingestion_date"].day) for r in ledger.read_days(spark, bronze, SCHEMA).collect())


def once(*pairs):
    return Counter((i, d) for ids, d in pairs for i in ids)


def test_a_day_over_two_batches_and_a_batch_that_comes_twice(spark, tmp_path):
    bronze = str(tmp_path)
    assert held(spark, bronze) == Counter()
    first = rows(spark, range(5), DAYS[0]).unionByName(rows(spark, range(5, 8), DAYS[1]))
    for _ in range(2):
        ledger.replace_days(first, bronze, "w", 0)
        assert held(spark, bronze) == once((range(5), 1), (range(5, 8), 2))
    ledger.replace_days(rows(spark, range(10, 12), DAYS[0]), bronze, "w", 1)
    ledger.replace_days(rows(spark, [], DAYS[0]), bronze, "w", 2)
    assert held(spark, bronze) == once(([*range(5), 10, 11], 1), (range(5, 8), 2))
    assert sorted(tuple(r) for r in ledger.live_versions(spark, bronze).collect()) == [(DAYS[0], 2, 7), (DAYS[1], 1, 3)]
    assert ledger.read_ledger(spark, bronze).filter("batch = 2 and day is null").count() == 1


def test_a_later_extract_replaces_its_day_and_an_earlier_one_does_not(spark, tmp_path):
    bronze = str(tmp_path)
    ledger.replace_days(rows(spark, range(5), DAYS[0]), bronze, "w", 0)
    ledger.replace_days(rows(spark, [1, 2, 9], DAYS[0], "e2", at=2), bronze, "w", 1)
    assert held(spark, bronze) == once(([1, 2, 9], 1))
    ledger.replace_days(rows(spark, [7], DAYS[0]), bronze, "w", 2)
    assert held(spark, bronze) == once(([1, 2, 9], 1))
    assert ledger.vacuum(spark, bronze) == 2
    assert held(spark, bronze) == once(([1, 2, 9], 1)) and len(list(Path(bronze).glob("days/_version=*/_ingestion_date=*"))) == 1


@pytest.mark.parametrize("where", ["before the ledger", "after the ledger"])
def test_a_stream_whose_second_batch_dies_gives_each_row_once(spark, tmp_path, monkeypatch, where):
    incoming, bronze, progress = (f"{tmp_path}/{n}" for n in ("incoming", "bronze", "progress"))
    for i in range(4):
        rows(spark, range(10 * i, 10 * i + 6), DAYS[i % 2]).coalesce(1).write.mode("append").parquet(incoming)
    start = lambda: jobs.bronze_stream(jobs.stream_landing(spark, spark.read.parquet(incoming).schema, incoming, files_a_batch=1), bronze, progress)
    real, calls = ledger.commit, []

    def dying(*args):
        calls.append(args[3])
        if where == "after the ledger" or len(calls) != 2:
            real(*args)
        if len(calls) == 2:
            raise RuntimeError("killed")

    monkeypatch.setattr(ledger, "commit", dying)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    before = held(spark, bronze)
    assert sum(before.values()) == (6 if where == "before the ledger" else 12) and set(before.values()) == {1}
    start().awaitTermination()
    assert held(spark, bronze) == once(*[(range(10 * i, 10 * i + 6), i % 2 + 1) for i in range(4)])
    assert calls == ([0, 1, 1, 2, 3] if where == "before the ledger" else [0, 1, 2, 3])


def test_files_that_no_ledger_names_are_not_read(spark, tmp_path):
    bronze = str(tmp_path)
    ledger.replace_days(rows(spark, [1], DAYS[0]), bronze, "w", 0)
    rows(spark, [2], DAYS[0]).write.partitionBy("_ingestion_date").parquet(f"{bronze}/days/_version=9")
    assert held(spark, bronze) == once(([1], 1))
    plan = ledger.read_days(spark, bronze, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_version" in plan
    assert ledger.read_days(spark, bronze, SCHEMA).select(F.max("id")).first()[0] == 1

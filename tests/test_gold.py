"""Gold tables after one more landing day against tables built at once, and histories in any order of arrival."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakemill.operators.history import dedup_versions, merge_scd2, scd2
from lakemill.plans import movement
from lakemill.plans.gold import MARTS, Gold
from lakemill.sources import ledger
from lakemill.sources.adapters import bronze
from tests.comparing import SF

FIRST, NEXT = date(1998, 1, 10), date(1998, 1, 11)


def source(spark):
    """Bronze of a few months; every seventh order comes three weeks late, after its lines."""

    def rows(table):
        df = bronze(spark, SF, table)
        if table == "orders":
            df = df.filter("order_ts >= '1997-11-01' and order_ts < '1998-03-01'")
            return df.withColumn("_ingestion_date", F.when(F.col("order_id") % 7 == 0, F.date_add("_ingestion_date", 21)).otherwise(F.col("_ingestion_date")))
        return df.filter("updated_at >= '1997-11-01' and updated_at < '1998-04-01'") if table == "order_items" else df

    return rows


def contents(gold, name):
    df = gold.read(name)
    columns = sorted(c for c in df.columns if c not in ("bits", "_ingestion_date"))
    return sorted(map(str, df.select(*[F.col(c).cast("string") for c in columns], *([F.md5("bits")] if "bits" in df.columns else [])).collect()))


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet") if "/days/" in str(p)}


def test_one_more_day_equals_a_full_build_and_leaves_other_files(spark, tmp_path, monkeypatch):
    step = Gold(spark, source(spark), f"{tmp_path}/step")
    step.refresh(FIRST)
    before = files(f"{tmp_path}/step")
    assert step.refreshed() == FIRST and step.read("lines").filter("business_date is null").count() > 0
    real = ledger.publish

    def dying(rows, table, *args):
        if table.endswith("store_performance"):
            raise RuntimeError("killed")
        return real(rows, table, *args)

    monkeypatch.setattr(ledger, "publish", dying)
    with pytest.raises(RuntimeError, match="killed"):
        step.refresh(NEXT)
    monkeypatch.undo()
    assert step.refreshed() == FIRST
    step.refresh(NEXT)
    whole = Gold(spark, source(spark), f"{tmp_path}/whole")
    whole.refresh(NEXT)
    for name in ("orders", *MARTS):
        assert contents(step, name) == contents(whole, name), name
    assert contents(step, "lines") == contents(whole, "lines")
    after = files(f"{tmp_path}/step")
    assert before.items() <= after.items()
    months = {(p.parts[-5], p.parts[-2].split("=")[1]) for p in after.keys() - before.keys()}
    assert {m for t, m in months if t == "orders"} and ("orders", "1997-12-01") not in months
    plan = step.read("orders").filter("order_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters" in plan


def test_orders_lines_and_payments_join_without_a_shuffle(spark):
    plan = movement.queries()["snk8_colocated"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan


def versions(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, at timestamp_ntz, _ingestion_date date")


def test_versions_in_any_order_of_arrival_give_one_history(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        for n in range(rng.randint(1, 6)):
            at = datetime(2026, 1, 1) + timedelta(days=rng.randint(0, 9))
            rows += [(i, f"v{n}-{k}", at, date(2026, 1, 20 + k)) for k in range(rng.randint(1, 3))]
    rows = list({(r[0], r[2], r[3]): r for r in rows}.values())
    shown = lambda df: sorted(str(r) for r in df.select("id", "name", "valid_from", "valid_to", "is_current").collect())
    want = shown(scd2(dedup_versions(versions(spark, rows), "id", "at"), "id", "at"))
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        held = scd2(versions(spark, []), "id", "at")
        for a in range(0, len(rows), 25):
            came = versions(spark, rows[a : a + 25])
            merged = merge_scd2(held, came, "id", "at")
            rest = held.join(came.select("id").distinct(), "id", "left_anti")
            held = spark.createDataFrame(rest.unionByName(merged).collect(), held.schema)
        assert shown(held) == want
    assert merge_scd2(held, versions(spark, rows[:1]), "id", "at").select("id").distinct().count() == 1

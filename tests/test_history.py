from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakemill.operators import quality as dq
from lakemill.operators.history import dedup_versions, interval_overlaps, latest_state, pit_join, pit_join_union, scd2, snapshot_changes
from lakemill.operators.selection import tiles_by_selection
from lakemill.operators.spine import dim_date, store_calendar


def ts(day: int, hour: int = 0) -> datetime:
    return datetime(2026, 1, day, hour)


def test_replay_gives_one_version_and_a_refund_two(spark):
    rows = [(1, ts(1), "completed", "2026-01-01"), (1, ts(1), "completed", "2026-01-02"), (1, ts(3), "refunded", "2026-01-03")]
    df = spark.createDataFrame(rows, "id long, updated_at timestamp_ntz, status string, _ingestion_date string")
    silver = dedup_versions(df, "id", "updated_at")
    assert sorted((r["status"], r["_ingestion_date"]) for r in silver.collect()) == [("completed", "2026-01-02"), ("refunded", "2026-01-03")]
    assert [r["status"] for r in latest_state(df, "id", "updated_at").collect()] == ["refunded"]


def test_point_in_time_at_the_edges(spark):
    versions = scd2(spark.createDataFrame([(1, ts(2), "a"), (1, ts(5), "b")], "id long, updated_at timestamp_ntz, v string"), "id", "updated_at")
    fact = spark.createDataFrame([(10, 1, ts(1)), (11, 1, ts(2)), (12, 1, ts(5)), (13, 1, ts(4, 23)), (14, 2, ts(3)), (15, None, ts(3))], "f long, fid long, at timestamp_ntz")
    want = [(10, None), (11, "a"), (12, "b"), (13, "a"), (14, None), (15, None)]
    joined = pit_join(fact, versions.select("id", "v", "valid_from", "valid_to"), "fid", "id", "at")
    assert sorted((r["f"], r["v"]) for r in joined.collect()) == want
    union = pit_join_union(fact, versions.select("id", "v", "valid_from", "valid_to"), "fid", "id", "at", ["v"])
    assert sorted((r["f"], r["v"]) for r in union.collect()) == want


def test_planted_overlap(spark):
    df = spark.createDataFrame([(1, ts(1), ts(4)), (1, ts(3), None), (2, ts(1), ts(2)), (2, ts(2), None)], "id long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert [(r["id"], r["valid_from"]) for r in interval_overlaps(df, "id").collect()] == [(1, ts(3))]


def test_unchanged_rows_give_no_version(spark):
    schema = "id long, v string, updated_at timestamp_ntz"
    before = spark.createDataFrame([(1, "a", ts(1)), (2, None, ts(1)), (3, "c", ts(1))], schema)
    after = spark.createDataFrame([(1, "a", ts(1)), (2, "b", ts(1)), (3, "d", ts(2)), (4, "e", ts(1))], schema)
    out = snapshot_changes(before, after, "id", "updated_at", F.lit(ts(9)).cast("timestamp_ntz"))
    assert sorted((r["id"], r["updated_at"]) for r in out.collect()) == [(2, ts(9)), (3, ts(2)), (4, ts(1))]


@pytest.mark.parametrize("n", [0, 3, 5, 6, 23])
def test_tiles_are_those_of_ntile(spark, n):
    df = spark.createDataFrame([(i, i % 4) for i in range(n)], "id long, v long")
    got = sorted((r["id"], r["t"]) for r in tiles_by_selection(df, 5, "id", {"t": F.col("v")}).collect())
    order = sorted(range(n), key=lambda i: (i % 4, i))
    short, more = divmod(n, 5)
    tiles = [t + 1 for t in range(5) for _ in range(short + (t < more))]
    assert got == sorted(zip(order, tiles))


def test_iso_year_edge_and_no_gap(spark):
    days = dim_date(spark.createDataFrame([("2026-12-30",), ("2027-01-02",)], "d string").selectExpr("cast(d as date) as business_date")).orderBy("calendar_date").collect()
    assert [(str(r["calendar_date"]), r["iso_year"], r["iso_week"]) for r in days][2] == ("2027-01-01", 2026, 53)
    assert len(days) == 4 and dq.date_gaps(spark.createDataFrame(days), "calendar_date").count() == 0


def test_store_days_follow_versions_and_closing(spark):
    fact = spark.sql("select cast(d as date) as business_date from values ('2026-01-01'), ('2026-01-10') v(d)")
    stores = spark.sql(
        """select cast(id as long) store_id, sk store_sk, date'2026-01-03' opened_date, cast(closed as date) closed_date, status, cast(f as timestamp_ntz) valid_from, cast(t as timestamp_ntz) valid_to
        from values (1, 'a', null, 'active', '2025-12-01', '2026-01-05 15:00:00'), (1, 'b', '2026-01-08', 'closed', '2026-01-05 15:00:00', null) v(id, sk, closed, status, f, t)"""
    )
    got = sorted((r["store_sk"], r["business_date"].day) for r in store_calendar(fact, stores).collect())
    assert got == [("a", 3), ("a", 4), ("a", 5), ("b", 6), ("b", 7), ("b", 8)]


def test_quality_operators(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k long, v string")
    assert [(r["k"], r["n"]) for r in dq.duplicates(df, ["k"]).collect()] == [(1, 2)]
    assert dq.null_counts(df, ["k", "v"], "t").collect()[0]["nulls"] == 2
    assert dq.orphans(df, "k", spark.createDataFrame([(2,)], "id long"), "id").count() == 2
    ok, bad = dq.row_rules(df, {"v_small": F.col("v") < "c"})
    assert ok.count() == 2 and {r["broken"][0] for r in bad.collect()} == {"v_small"}
    assert sorted(r["side"] for r in dq.set_diff(df, spark.createDataFrame([(2,)], "k long"), "k").filter("k is not null").collect()) == ["left", "right"]

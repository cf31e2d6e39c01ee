"""Tiles against ntile, and bitmaps against distinct counts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakemill.operators.bitmaps import bitmaps, counted, united
from lakemill.operators.selection import BINS, tile_bounds, tiles_by_selection

FAR = 2**63


def values(kind, n, rng):
    return {
        "ties": lambda: rng.randint(0, 3), "one": lambda: 7, "wide": lambda: rng.randint(-FAR, FAR - 1), "edges": lambda: rng.choice([-FAR, FAR - 1, 0, -1, 1]), "money": lambda: rng.randint(-10**9, 10**9),
    }[kind]


@pytest.mark.parametrize("n,tiles", [(0, 5), (1, 5), (3, 5), (5, 5), (1000, 5), (1003, 10), (997, 1)])
def test_equal_to_ntile(spark, n, tiles):
    rng = random.Random(n)
    kinds = ["ties", "one", "wide", "edges", "money"]
    keys = rng.sample(range(-10 * n - 10, 10 * n + 10), n)
    rows = [(k, *(values(kind, n, rng)() for kind in kinds)) for k in keys]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{k} long" for k in kinds)).repartition(3).cache()
    got = tiles_by_selection(df, tiles, "id", {f"t_{k}": F.col(k) for k in kinds})
    for k in kinds:
        got = got.withColumn(f"w_{k}", F.ntile(tiles).over(Window.orderBy(k, "id")).cast("long"))
    wrong = got.filter(" OR ".join(f"t_{k} <> w_{k}" for k in kinds))
    assert got.count() == n and wrong.count() == 0


def test_falling_order_and_few_passes(spark, monkeypatch):
    from lakemill.operators import selection

    df = spark.range(5000).selectExpr("id", "id * 7919 % 100003 v").cache()
    passes, real = [], selection._counted
    monkeypatch.setattr(selection, "_counted", lambda *a: passes.append(1) or real(*a))
    got = tiles_by_selection(df, 4, "id", {"t": -F.col("v")})
    wrong = got.withColumn("w", F.ntile(4).over(Window.orderBy(F.desc("v"), "id"))).filter("t <> w")
    assert wrong.count() == 0 and len(passes) <= 3


def test_rows_are_compared_with_literals_only(spark):
    df = spark.range(3 * BINS).selectExpr("id", "id % 5 v").cache()
    df.count()
    plan = tiles_by_selection(df, 5, "id", {"t": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert tile_bounds(df, 2, "id", {"t": F.col("v")}) == {"t": [(2, 1527)]}


def test_bitmaps_equal_distinct_counts_at_every_grain(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(1, 3), rng.choice([None, rng.randint(0, 50), rng.randint(-10**6, 10**12)]), rng.randint(0, 40_000)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, d int, x long, y long").cache()
    fine = bitmaps(df, ["g", "d"], {"x": F.col("x"), "y": F.col("y")})
    for by in (["g", "d"], ["g"], ["d"], []):
        want = {tuple(r) for r in df.groupBy(*by).agg(F.countDistinct("x"), F.countDistinct("y")).collect()}
        assert {tuple(r) for r in counted(fine, by, ["x", "y"]).collect()} == want
        assert {tuple(r) for r in counted(united(fine, ["g", "d"]), by, ["x", "y"]).collect()} == want
    some = counted(fine.filter("g = 'a' AND d > 1"), [], ["x"]).first()[0]
    assert some == df.filter("g = 'a' AND d > 1").select("x").dropna().distinct().count()
    assert counted(bitmaps(df.limit(0), ["g"], {"x": F.col("x")}), ["g"], ["x"]).count() == 0

"""Store-days as spans with their days of sales: what is written and moved, and the same rows as a calendar gives."""

from __future__ import annotations

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakemill.operators.spine import each_store_day, open_days, repeated_store_days, with_sold_days
from lakemill.plans import catalogue, gold
from lakemill.plans.warehouse import release, warehouse
from tests.comparing import SF


def tables(path):
    return {t for t in os.listdir(path.removeprefix("file:")) if not t.startswith(("_", "."))}


def spans(spark):
    days = lambda a, b: (date(2026, 1, a), date(2026, 1, b))
    held = spark.createDataFrame([(1, "a", *days(1, 4)), (1, "b", *days(5, 5)), (2, "c", *days(3, 9))], "store_id long, store_sk string, low date, high date")
    sold = spark.createDataFrame([(1, "a", date(2026, 1, 2), 7), (2, "c", date(2026, 1, 3), 1), (2, "c", date(2026, 1, 9), 2)], "store_id long, store_sk string, business_date date, n long")
    return held, with_sold_days(held, sold, ["store_id", "store_sk"])


def test_spans_give_each_day_once_and_count_open_stores(spark):
    held, with_sales = spans(spark)
    rows = each_store_day(with_sales).collect()
    assert len(rows) == 12 and sum(r["n"] for r in rows) == 10
    assert {(r["store_id"], r["business_date"].day) for r in rows if r["n"]} == {(1, 2), (2, 3), (2, 9)}
    counted = {r["business_date"].day: r["stores"] for r in open_days(held, "stores").collect()}
    assert counted == {d: (d <= 5) + (3 <= d <= 9) for d in range(1, 10)}
    assert open_days(held.limit(0), "stores").count() == 0


def test_repeated_days_are_found_store_by_store(spark):
    _, with_sales = spans(spark)
    assert repeated_store_days(with_sales).first()["n"] == 0
    twice = with_sales.unionByName(with_sales.filter("store_sk = 'c'")).withColumn("high", F.expr("if(store_sk = 'a', date'2026-01-06', high)"))
    by_key = each_store_day(twice).groupBy("store_day_key").count().filter("count > 1").count()
    assert repeated_store_days(twice).first()["n"] == by_key == 8
    assert repeated_store_days(twice.limit(0)).first()["n"] == 0


@pytest.mark.parametrize("name", ["bi02_transactions", "bi03_aov", "bi04_ads", "bi05_adq", "bi06_margin", "bi07_sales_by_day", "bi09_ads_by_day", "dq11_kpi_formulas", "dq11_more_formulas"])
def test_days_of_the_chain_write_no_store_days_and_no_lines(spark, name):
    release(spark, SF)
    assert catalogue.queries()[name](spark, SF).count() > 0
    assert tables(warehouse(spark, SF).path) == {"fct_orders", "executive_daily"}


@pytest.mark.parametrize("name", ["flt5_filtered_stores", "dq02_more_unique", "dq02_unique"])
def test_keys_of_store_days_are_not_moved(spark, name):
    release(spark, SF)
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "store_day_key" not in "".join(line for line in plan.splitlines() if "Exchange" in line or "Aggregate" in line)
    w = warehouse(spark, SF)
    assert not tables(w.path) & {"store_performance", "product_performance", "fct_order_items"}
    written = spark.read.parquet(f"{w.path}/fct_store_daily_sales")
    assert written.count() == w.store_spans.count() < w.fct_store_daily_sales.count() / 100


@pytest.mark.parametrize(("name", "made"), [
    ("his1_merged", {"stores", "products"}), ("agg17_bitmaps", {"stores", "orders", "daily_totals", "daily_sets"}),
    ("mrt1_incremental_executive_daily", {"stores", "products", "orders", "lines", "executive_daily"}),
    ("mrt3_incremental_product_performance", {"stores", "products", "orders", "lines", "product_performance"}),
    ("fct4_incremental_fct_store_daily_sales", {"stores", "products", "orders", "lines", "fct_store_daily_sales"}),
    ("mrt2_incremental_store_performance", {"stores", "products", "orders", "lines", "store_performance"}),
])
def test_a_query_refreshes_only_what_it_reads(spark, monkeypatch, name, made):
    asked, real = [], gold.gold
    monkeypatch.setattr(gold, "gold", lambda *a: asked.append(real(*a)) or asked[-1])
    catalogue.queries()[name](spark, SF)
    assert tables(asked[0].path) == made
    for mart in made & {"fct_store_daily_sales", "store_performance"}:
        assert asked[0].held(mart).count() < asked[0].read(mart).count() / 10


def test_sets_of_days_are_lists_and_hold_every_day(spark):
    g = gold.gold(spark, SF, "daily_totals", "daily_sets")
    sets = g.read("daily_sets")
    days = sets.filter("kind = 'stores'").agg(F.sum(F.size("places") * (F.datediff("until", "business_date") + 1))).first()[0]
    assert days == warehouse(spark, SF).store_calendar.count()
    assert sets.agg(F.max(F.size("places"))).first()[0] <= 32768 and "bits" not in sets.columns
    assert sets.filter("until < business_date or trunc(until, 'month') <> trunc(business_date, 'month')").count() == 0

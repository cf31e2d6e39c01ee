from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lakemill.plans import catalogue
from lakemill.plans.warehouse import Warehouse, release
from tests.comparing import SF, same

CHECKED = [
    "daily_sales", "silver_orders", "dim_store", "dim_date", "fct_orders", "fct_order_items", "fct_store_daily_sales", "executive_daily", "product_performance", "customer_cohorts", "customer_rfm",
    "bi21_top_stores", "bi26_store_table", "rp6_region_days", "flt5_filtered_stores", "pt02_store_types", "pt10_top_decile", "pt14_category_daypart", "bi41_cohort_pivot", "win10_inversions",
    "tir1_upgrades", "dq05_overlaps", "dq10_reconciliations", "dq14_rejected", "dq16_money_rules", "ing2_incremental", "snk5_landing_to_bronze", "rec3_full", "str2_without_replays", "pit_join_union",
    "bi22_bottom_stores", "bi23_store_type_ads", "bi25_region_pivot", "bi42_tiers", "flt5_filtered_regions", "flt5_filtered_store_names", "flt5_filtered_product_ids", "flt5_filtered_segments",
    "flt5_filtered_cohorts", "flt7_trading_days", "pt15_quantities", "pt20_recent_writes", "pt22_changed_rows", "pt24_launches", "spn3_minutes", "dq07_calendar_gaps", "dq09_rfm_metrics", "dq11_more_formulas",
    "snk8_clustered", "snk9_audit", "silver_regions", "silver_payments", "fct_payments", "rec2_covered", "rec5_load_statuses", "str1_bronze", "str3_day_counts", "bi41_cohort_all_months", "pt13_top_fifth", "snk8_colocated",
    "his1_merged", "fct4_incremental_fct_store_daily_sales", "mrt1_incremental_executive_daily", "mrt2_incremental_store_performance", "mrt3_incremental_product_performance", "agg17_bitmaps", "flt7_sellable_products", "rec3_ranges", "win10_products",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_counterpart(spark, name):
    same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_query_has_a_counterpart():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_has_rows_and_oracles_have_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("fact", ["fct_orders", "fct_order_items", "fct_store_daily_sales"])
def test_a_fact_scans_the_orders_once(spark, monkeypatch, fact):
    """The fact of orders is written from one scan; what stands on it reads the written table."""
    release(spark, SF)
    plans, real = {}, Warehouse.kept
    monkeypatch.setattr(Warehouse, "kept", lambda self, name, df: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or real(self, name, df))
    shown = catalogue.queries()[fact](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plans["fct_orders"].count("/orders.parquet") == 1 and "/orders.parquet" not in shown
    assert all("/orders.parquet" not in plan and "InMemoryTableScan" not in plan for name, plan in plans.items() if name != "fct_orders")


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = catalogue.queries()["bi01_sales"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "l_returnflag" not in plan.split("Physical Plan")[-1]

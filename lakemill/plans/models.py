"""Queries that return the layers, dimensions, facts and marts themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators.history import pit_join, pit_join_union
from lakemill.operators.spine import dim_time
from lakemill.plans.counterpart import over_warehouse
from lakemill.plans.warehouse import warehouse


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and counts as longs, once, at the end."""
    kind = {"decimal": "double", "int": "bigint", "smallint": "bigint"}
    return df.select(*[F.col(n).cast(kind[t.split("(")[0]]).alias(n) if t.split("(")[0] in kind else F.col(n) for n, t in df.dtypes])


#: Columns of each frame that the query returns, with the type that the counterpart casts to.
SHOWN = {
    "silver_regions": ("s_regions", "region_id region_name"),
    "silver_areas": ("s_areas", "area_id region_id area_name"),
    "silver_product_categories": ("s_product_categories", "category_id category_name category_group"),
    "silver_stores": ("s_stores", "store_id area_id store_type opened_date closed_date status updated_at"),
    "silver_products": ("s_products", "product_id category_id unit_cost:d updated_at"),
    "silver_customers": ("s_customers", "customer_id full_name loyalty_tier updated_at"),
    "silver_promotions": ("s_promotions", "promotion_id promo_code promo_type start_date end_date updated_at"),
    "silver_orders": ("s_orders", "order_id store_id customer_id order_status total_amount:d updated_at _ingestion_date"),
    "silver_order_items": ("s_order_items", "order_item_id order_id product_id supplier_id quantity line_total:d updated_at _ingestion_date"),
    "silver_payments": ("s_payments", "payment_id order_id payment_method amount:d payment_status updated_at"),
    "latest_orders": ("l_orders", "order_id store_id customer_id order_status total_amount:d updated_at"),
    "dim_store": ("dim_store", "store_sk store_id store_name store_type city area_name region_name opened_date closed_date status valid_from valid_to is_current"),
    "dim_product": ("dim_product", "product_sk product_id product_name category_name category_group base_price:d unit_cost:d valid_from valid_to is_current"),
    "dim_customer": ("dim_customer", "customer_sk customer_id full_name city loyalty_tier signup_date updated_at"),
    "dim_promotion": ("dim_promotion", "promotion_sk promotion_id promo_code promo_name promo_type discount_value:d start_date end_date"),
    "dim_date": ("dim_date", "date_key:i calendar_date year:i quarter:i month_number:i month_name iso_year:i iso_week:i day_of_month:i day_of_week_number:i day_name week_start_date month_start_date quarter_start_date year_start_date is_weekend"),
    "fct_orders": ("fct_orders", "order_id store_id store_sk customer_id promotion_id order_ts business_date order_channel order_status subtotal:d total_amount:d"),
    "fct_order_items": ("fct_order_items", "order_item_id order_id product_id product_sk store_sk business_date order_status quantity line_total:d unit_cost:d line_cost:d gross_margin:d"),
    "fct_payments": ("fct_payments", "payment_id order_id store_id business_date payment_method payment_status amount:d order_status"),
    "store_calendar": ("store_calendar", "store_id store_sk business_date store_day_key"),
    "daily_orders": ("daily_orders", "store_id store_sk business_date transaction_count:i total_sales:d"),
    "daily_items": ("daily_items", "store_id store_sk business_date product_quantity:i item_sales:d total_cost:d gross_margin:d"),
    "fct_store_daily_sales": ("fct_store_daily_sales", "store_id store_sk business_date store_day_key transaction_count:i product_quantity:i total_sales:d item_sales:d total_cost:d gross_margin:d average_order_value"),
    "executive_daily": ("executive_daily", "business_date date_key:i store_days:i active_stores:i transaction_count:i product_quantity:i total_sales:d item_sales:d total_cost:d gross_margin:d average_order_value average_daily_sales average_daily_quantity margin_rate"),
    "store_performance": ("store_performance", "store_id store_sk business_date store_day_key store_name store_type area_name region_name is_weekend transaction_count:i total_sales:d gross_margin:d margin_rate"),
    "product_performance": ("product_performance", "product_day_key business_date product_id product_name category_name order_count:i line_count:i quantity_sold:i product_sales:d product_cost:d gross_margin:d average_selling_price margin_rate"),
    "customer_cohorts": ("customer_cohorts", "cohort_month_key cohort_month activity_month month_number:i cohort_size:i active_customers:i transaction_count:i total_sales:d retention_rate sales_per_active_customer"),
    "customer_rfm": ("customer_rfm", "customer_id customer_sk full_name loyalty_tier as_of_date first_purchase_date last_purchase_date recency_days:i frequency:i monetary:d average_order_value recency_score:i frequency_score:i monetary_score:i rfm_score rfm_total_score:i customer_segment"),
}


def frame(w, name: str) -> DataFrame:
    layer, _, table = name.partition("_")
    return w.silver(table) if layer == "silver" else w.latest(table) if layer == "latest" else w.mart(name)


def _shown(name: str):
    def query(spark, sf_dir: str) -> DataFrame:
        return plain(frame(warehouse(spark, sf_dir), name).select(*[c.split(":")[0] for c in SHOWN[name][1].split()]))

    return query


def _shown_sql(name: str) -> str:
    table, columns = SHOWN[name]
    casts = {"d": "DOUBLE", "i": "BIGINT"}
    listed = [f"{c[:-2]}::{casts[c[-1]]} AS {c[:-2]}" if ":" in c else c for c in columns.split()]
    return over_warehouse(f"SELECT {', '.join(listed)} FROM {table}")


def point_in_time(spark, sf_dir: str) -> DataFrame:
    """Orders with the store version of their instant, by equi join with a residual."""
    w = warehouse(spark, sf_dir)
    versions = w.dim_store.select("store_id", "area_id", "valid_from", "valid_to")
    return pit_join(w.latest("orders").select("order_id", F.col("store_id").alias("sold_at"), "order_ts"), versions, "sold_at", "store_id", "order_ts").select("order_id", "sold_at", "area_id")


def point_in_time_union(spark, sf_dir: str) -> DataFrame:
    """The same by one ordered pass over versions and orders."""
    w = warehouse(spark, sf_dir)
    versions = w.dim_store.select("store_id", "area_id", "valid_from", "valid_to")
    return pit_join_union(w.latest("orders").select("order_id", F.col("store_id").alias("sold_at"), "order_ts"), versions, "sold_at", "store_id", "order_ts", ["area_id"]).select("order_id", "sold_at", "area_id")


_PIT = over_warehouse("SELECT order_id, o.store_id AS sold_at, area_id FROM l_orders o LEFT JOIN dim_store s ON o.store_id = s.store_id AND order_ts >= valid_from AND (valid_to IS NULL OR order_ts < valid_to)")


def queries() -> dict:
    out = {name: _shown(name) for name in SHOWN}
    return out | {"pit_join": point_in_time, "pit_join_union": point_in_time_union}


def oracle_sql() -> dict[str, str]:
    out = {name: _shown_sql(name) for name in SHOWN}
    return out | {"pit_join": _PIT, "pit_join_union": _PIT}

"""The warehouse in DuckDB SQL, as common table expressions to put a query after."""

from __future__ import annotations

from lakemill.sources.adapters import LATE_MINUTES, ZONE_HOURS

_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END"
_LOCAL = f"(updated_at + INTERVAL {ZONE_HOURS} HOUR)"
_VERSIONED = {"stores": "store_id", "products": "product_id", "customers": "customer_id", "promotions": "promotion_id", "orders": "order_id", "order_items": "order_item_id", "payments": "payment_id"}
_TIE = {"order_items": ", product_id DESC, supplier_id DESC"}

_SOURCES = f"""
v_stores AS (
  SELECT s_suppkey AS store_id, ((s_nationkey + k) % 25)::BIGINT AS area_id, 'S' || s_suppkey AS store_code, s_name AS store_name,
    (['mall', 'street', 'office', 'drive_thru', 'kiosk'])[s_suppkey % 5 + 1] AS store_type, 'City ' || ((s_nationkey + k) % 25) AS city,
    DATE '1994-12-01' + (s_suppkey % 400)::INT AS opened_date, CASE WHEN k = 1 AND s_suppkey % 17 = 16 THEN DATE '2000-06-30' END AS closed_date,
    CASE WHEN k = 1 AND s_suppkey % 17 = 16 THEN 'closed' ELSE 'active' END AS status,
    TIMESTAMP '1994-11-01' + to_days((k * (1150 + s_suppkey % 30))::INT) + to_seconds(k * 54000) AS updated_at
  FROM supplier, (VALUES (0), (1)) v(k)
), v_products AS (
  SELECT p_partkey AS product_id, ({_TYPE})::BIGINT AS category_id, 'P' || p_partkey AS sku, p_name AS product_name, p_retailprice::DECIMAL(12,2) AS base_price,
    (p_retailprice::DECIMAL(12,2) - 500 + 10 * k)::DECIMAL(12,2) AS unit_cost, TIMESTAMP '1994-12-01' + to_days((800 * k + p_partkey % 200)::INT) AS updated_at
  FROM part, (VALUES (0), (1), (2)) v(k)
), v_customers AS (
  SELECT c_custkey AS customer_id, c_name AS full_name, 'City ' || c_nationkey AS city, DATE '1994-06-01' AS signup_date,
    CASE WHEN k = 0 THEN 'basic' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'silver' WHEN c_mktsegment = 'BUILDING' THEN 'gold' WHEN c_mktsegment = 'FURNITURE' THEN 'platinum' ELSE 'basic' END AS loyalty_tier,
    TIMESTAMP '1994-12-01' + to_days(k * 548) AS updated_at
  FROM customer, (VALUES (0), (1)) v(k)
), v_promotions AS (
  SELECT n_nationkey::BIGINT AS promotion_id, 'PROMO' || n_nationkey AS promo_code, 'Campaign ' || n_nationkey AS promo_name, (['percent', 'fixed', 'bundle'])[n_nationkey % 3 + 1] AS promo_type,
    (5 + n_nationkey)::DECIMAL(12,2) AS discount_value, DATE '1995-01-01' + (90 * n_nationkey)::INT AS start_date, DATE '1995-01-01' + (90 * n_nationkey + 60)::INT AS end_date, TIMESTAMP '1994-12-01' AS updated_at
  FROM nation
), v_orders AS (
  SELECT o_orderkey AS order_id, o_orderkey % (SELECT count(*) FROM supplier) AS store_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS customer_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 25 END AS promotion_id,
    o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS order_ts, (['dine_in', 'takeaway', 'delivery'])[o_orderkey % 3 + 1] AS order_channel,
    CASE WHEN o_orderkey % 50 = 0 THEN 'cancelled' WHEN k = 1 THEN 'refunded' ELSE 'completed' END AS order_status,
    o_totalprice::DECIMAL(12,2) AS subtotal, 0::DECIMAL(12,2) AS discount_amount, 0::DECIMAL(12,2) AS tax_amount, o_totalprice::DECIMAL(12,2) AS total_amount,
    o_orderdate + to_seconds((o_orderkey * 7919) % 86400) + to_days(2 * k) AS updated_at
  FROM orders, (VALUES (0), (1)) v(k) WHERE k = 0 OR (o_orderkey % 50 <> 0 AND o_orderstatus = 'P' AND o_orderkey % 4 = 0)
), v_order_items AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS supplier_id, l_quantity::BIGINT AS quantity,
    0::DECIMAL(12,2) AS line_discount, l_extendedprice::DECIMAL(12,2) AS line_total, l_shipdate AS updated_at FROM lineitem
), v_payments AS (
  SELECT order_id * 10 + n AS payment_id, order_id, (['cash', 'card', 'e_wallet'])[order_id % 3 + 1] AS payment_method, total_amount AS amount, s AS payment_status, order_ts AS paid_at, updated_at
  FROM v_orders, (VALUES (1, 'paid'), (2, 'refunded'), (3, 'failed')) v(n, s)
  WHERE (n = 1 AND order_status <> 'refunded') OR (n = 2 AND order_status = 'refunded') OR (n = 3 AND order_status <> 'refunded' AND order_id % 80 = 0)
), s_regions AS (SELECT r_regionkey::BIGINT AS region_id, r_name AS region_name FROM region),
s_areas AS (SELECT n_nationkey::BIGINT AS area_id, n_regionkey::BIGINT AS region_id, n_name AS area_name FROM nation),
s_product_categories AS (SELECT DISTINCT ({_TYPE})::BIGINT AS category_id, p_type AS category_name, (['beverage', 'food', 'merchandise'])[({_TYPE}) % 3 + 1] AS category_group FROM part)
"""


def _layers(table: str, key: str) -> str:
    """Bronze with replay copies, silver versions and the latest state of one table."""
    order = f"_ingestion_date DESC{_TIE.get(table, '')}"
    return f"""
b_{table} AS (
  SELECT *, {_LOCAL}::DATE AS _ingestion_date FROM v_{table} UNION ALL
  SELECT *, {_LOCAL}::DATE + 1 FROM v_{table} WHERE {_LOCAL} >= ({_LOCAL}::DATE + 1)::TIMESTAMP - INTERVAL {LATE_MINUTES} MINUTE
), s_{table} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {key}, updated_at ORDER BY {order}) AS n FROM b_{table}) WHERE n = 1),
l_{table} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY updated_at DESC, {order}) AS n FROM b_{table}) WHERE n = 1)"""


_KEY = "md5({0}::VARCHAR || '|' || strftime(valid_from, '%Y-%m-%d %H:%M:%S.%f'))"
_R = "(floor({0}::DOUBLE / nullif({1}::DOUBLE, 0) * 1e{2} + 0.5) / 1e{2})"
SALES = ("transaction_count", "product_quantity", "subtotal", "discount_amount", "tax_amount", "total_sales", "item_sales", "total_cost", "gross_margin")
_SUMS = ", ".join(f"sum({c}) AS {c}" for c in SALES)
_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in SALES)

_GOLD = f"""
store_versions AS (SELECT * EXCLUDE (updated_at, _ingestion_date), updated_at AS valid_from, lead(updated_at) OVER (PARTITION BY store_id ORDER BY updated_at) AS valid_to FROM s_stores),
product_versions AS (SELECT * EXCLUDE (updated_at, _ingestion_date), updated_at AS valid_from, lead(updated_at) OVER (PARTITION BY product_id ORDER BY updated_at) AS valid_to FROM s_products),
dim_store AS (SELECT v.*, valid_to IS NULL AS is_current, area_name, a.region_id, region_name, {_KEY.format('store_id')} AS store_sk FROM store_versions v LEFT JOIN s_areas a USING (area_id) LEFT JOIN s_regions r ON a.region_id = r.region_id),
dim_product AS (SELECT v.*, valid_to IS NULL AS is_current, category_name, category_group, {_KEY.format('product_id')} AS product_sk FROM product_versions v LEFT JOIN s_product_categories USING (category_id)),
dim_customer AS (SELECT * EXCLUDE (_ingestion_date), md5(customer_id::VARCHAR) AS customer_sk FROM l_customers),
dim_promotion AS (SELECT * EXCLUDE (_ingestion_date), md5(promotion_id::VARCHAR) AS promotion_sk FROM l_promotions),
fct_orders AS (
  SELECT o.* EXCLUDE (_ingestion_date), store_sk, (order_ts + INTERVAL {ZONE_HOURS} HOUR)::DATE AS business_date
  FROM l_orders o LEFT JOIN dim_store s ON o.store_id = s.store_id AND order_ts >= valid_from AND (valid_to IS NULL OR order_ts < valid_to)
),
fct_order_items AS (
  SELECT i.order_item_id, i.order_id, i.product_id, quantity, line_discount, line_total, o.store_id, store_sk, order_ts, business_date, order_status, product_sk, unit_cost,
    quantity::INT * unit_cost AS line_cost, line_total - quantity::INT * unit_cost AS gross_margin
  FROM l_order_items i JOIN fct_orders o USING (order_id) LEFT JOIN dim_product p ON i.product_id = p.product_id AND order_ts >= valid_from AND (valid_to IS NULL OR order_ts < valid_to)
),
fct_payments AS (SELECT p.* EXCLUDE (_ingestion_date), store_id, business_date, order_status FROM l_payments p LEFT JOIN fct_orders USING (order_id)),
days AS (SELECT unnest(generate_series(min(business_date), max(business_date), INTERVAL 1 DAY))::DATE AS d FROM fct_orders),
dim_date AS (
  SELECT strftime(d, '%Y%m%d')::INT AS date_key, d AS calendar_date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month_number, strftime(d, '%B') AS month_name,
    isoyear(d)::INT AS iso_year, week(d)::INT AS iso_week, day(d)::INT AS day_of_month, (dayofweek(d) + 1)::INT AS day_of_week_number, strftime(d, '%A') AS day_name,
    date_trunc('week', d)::DATE AS week_start_date, date_trunc('month', d)::DATE AS month_start_date, date_trunc('quarter', d)::DATE AS quarter_start_date, date_trunc('year', d)::DATE AS year_start_date,
    dayofweek(d) IN (0, 6) AS is_weekend FROM days
),
store_calendar AS (
  SELECT store_id, store_sk, d AS business_date, store_id || '-' || d AS store_day_key FROM days JOIN dim_store
  ON d >= opened_date AND (closed_date IS NULL OR d <= closed_date) AND d::TIMESTAMP - INTERVAL {ZONE_HOURS} HOUR >= valid_from AND (valid_to IS NULL OR d::TIMESTAMP - INTERVAL {ZONE_HOURS} HOUR < valid_to)
),
daily_orders AS (
  SELECT store_id, store_sk, business_date, count(*) AS transaction_count, sum(subtotal) AS subtotal, sum(discount_amount) AS discount_amount, sum(tax_amount) AS tax_amount, sum(total_amount) AS total_sales
  FROM fct_orders WHERE order_status = 'completed' GROUP BY ALL
),
daily_items AS (
  SELECT store_id, store_sk, business_date, sum(quantity) AS product_quantity, sum(line_total) AS item_sales, sum(line_cost) AS total_cost, sum(gross_margin) AS gross_margin
  FROM fct_order_items WHERE order_status = 'completed' GROUP BY ALL
),
fct_store_daily_sales AS (
  SELECT store_id, store_sk, business_date, store_day_key, {_FILLED}, {_R.format('total_sales', 'transaction_count', 2)} AS average_order_value
  FROM store_calendar LEFT JOIN daily_orders USING (store_id, store_sk, business_date) LEFT JOIN daily_items USING (store_id, store_sk, business_date)
),
executive_daily AS (
  SELECT t.*, dim_date.* EXCLUDE (calendar_date), {_R.format('total_sales', 'transaction_count', 2)} AS average_order_value, {_R.format('total_sales', 'store_days', 2)} AS average_daily_sales,
    {_R.format('product_quantity', 'store_days', 2)} AS average_daily_quantity, {_R.format('gross_margin', 'item_sales', 4)} AS margin_rate
  FROM (SELECT business_date, count(DISTINCT store_day_key) AS store_days, count(DISTINCT store_id) AS active_stores, {_SUMS} FROM fct_store_daily_sales GROUP BY business_date) t JOIN dim_date ON business_date = calendar_date
),
store_performance AS (
  SELECT f.*, store_name, store_type, city, area_name, region_name, year, month_number, is_weekend, {_R.format('gross_margin', 'item_sales', 4)} AS margin_rate
  FROM fct_store_daily_sales f JOIN dim_store s USING (store_sk) JOIN dim_date ON business_date = calendar_date
),
product_performance AS (
  SELECT l.*, product_id, product_name, category_name, category_group, strftime(business_date, '%Y%m%d') || '-' || product_sk AS product_day_key,
    {_R.format('product_sales', 'quantity_sold', 2)} AS average_selling_price, {_R.format('gross_margin', 'product_sales', 4)} AS margin_rate
  FROM (SELECT business_date, product_sk, count(DISTINCT order_id) AS order_count, count(*) AS line_count, sum(quantity) AS quantity_sold, sum(line_total) AS product_sales, sum(line_cost) AS product_cost, sum(gross_margin) AS gross_margin
        FROM fct_order_items WHERE order_status = 'completed' GROUP BY ALL) l JOIN dim_product p USING (product_sk)
),
identified AS (SELECT * FROM fct_orders WHERE order_status = 'completed' AND customer_id IS NOT NULL),
first_purchases AS (SELECT customer_id, min(business_date) AS first_purchase_date, date_trunc('month', min(business_date))::DATE AS cohort_month FROM identified GROUP BY customer_id),
customer_cohorts AS (
  SELECT *, cohort_month || '-' || month_number AS cohort_month_key, {_R.format('active_customers', 'cohort_size', 4)} AS retention_rate, {_R.format('total_sales', 'active_customers', 2)} AS sales_per_active_customer
  FROM (SELECT cohort_month, date_trunc('month', business_date)::DATE AS activity_month, date_diff('month', cohort_month, date_trunc('month', business_date)::DATE) AS month_number,
          count(DISTINCT customer_id) AS active_customers, count(*) AS transaction_count, sum(total_amount) AS total_sales FROM identified JOIN first_purchases USING (customer_id) GROUP BY ALL)
  JOIN (SELECT cohort_month, count(*) AS cohort_size FROM first_purchases GROUP BY ALL) USING (cohort_month)
),
rfm_metrics AS (
  SELECT *, date_diff('day', last_purchase_date, as_of_date) AS recency_days, {_R.format('monetary', 'frequency', 2)} AS average_order_value
  FROM (SELECT customer_id, min(business_date) AS first_purchase_date, max(business_date) AS last_purchase_date, count(DISTINCT order_id) AS frequency, sum(total_amount) AS monetary FROM identified GROUP BY customer_id),
       (SELECT max(business_date) AS as_of_date FROM fct_orders WHERE order_status = 'completed')
),
rfm_scores AS (
  SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS recency_score, ntile(5) OVER (ORDER BY frequency, customer_id) AS frequency_score, ntile(5) OVER (ORDER BY monetary, customer_id) AS monetary_score FROM rfm_metrics
),
customer_rfm AS (
  SELECT s.*, customer_sk, full_name, city, loyalty_tier, signup_date, recency_score || '' || frequency_score || '' || monetary_score AS rfm_score, recency_score + frequency_score + monetary_score AS rfm_total_score,
    CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions' WHEN recency_score >= 3 AND frequency_score >= 4 THEN 'Loyal Customers'
      WHEN recency_score >= 4 AND frequency_score BETWEEN 2 AND 3 THEN 'Potential Loyalists' WHEN recency_score = 5 AND frequency_score = 1 THEN 'New Customers'
      WHEN recency_score <= 2 AND frequency_score >= 3 THEN 'At Risk' WHEN recency_score <= 2 AND frequency_score <= 2 THEN 'Hibernating' ELSE 'Needs Attention' END AS customer_segment
  FROM rfm_scores s JOIN dim_customer USING (customer_id)
)"""

PRELUDE = "WITH " + _SOURCES.strip() + "," + ",".join(_layers(t, k) for t, k in _VERSIONED.items()) + "," + _GOLD


def over_warehouse(select: str) -> str:
    return f"{PRELUDE}\n{select}"

"""Pattern and insight queries over the latest source rows and the facts, and the pivoted KPI tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions.columns import local_date, local_time, ratio
from lakemill.functions.lineage import settle
from lakemill.operators.ranking import inversion_counts, rank_inversions, share_of_total
from lakemill.operators.selection import cents, tiles_by_selection
from lakemill.plans.counterpart import over_warehouse
from lakemill.plans.models import plain
from lakemill.plans.warehouse import warehouse
from lakemill.sources.adapters import ZONE_HOURS
from lakemill.sources.contracts import CONTRACTS
from lakemill.sources.tables import read_table

HOUR = "hour"


def _orders(w) -> DataFrame:
    return w.latest("orders").withColumns({"local_day": local_date("order_ts"), HOUR: F.hour(local_time("order_ts")).cast("long")})


def _current_stores(w) -> DataFrame:
    return w.dim_store.filter("is_current").select(F.col("store_id").alias("s"), "store_type", "store_name", "opened_date")


def _share(condition: Column) -> Column:
    """Percentage of rows that meet a condition."""
    return ratio(F.lit(100) * F.sum(F.when(condition, 1).otherwise(0)), F.count(F.lit(1)))


def row_counts(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    frames = [w.silver(t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows")) for t in CONTRACTS]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def store_type_profile(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    units = w.latest("order_items").groupBy(F.col("order_id").alias("o")).agg(F.sum("quantity").alias("units"))
    orders = _orders(w).filter("order_status <> 'cancelled'").join(_current_stores(w), F.col("store_id") == F.col("s")).join(units, F.col("order_id") == F.col("o"), "left")
    n = F.count(F.lit(1))
    return orders.groupBy("store_type").agg(
        n.alias("orders"),
        ratio(n, F.countDistinct("store_id", "local_day")).alias("orders_per_store_day"),
        ratio(F.sum(F.col("subtotal") - F.col("discount_amount")), n).alias("aov_net"),
        ratio(F.sum("units"), F.count("units")).alias("units_per_order"),
        _share(F.col("customer_id").isNull()).alias("walk_in_pct"),
    )


def orders_by_hour(spark, sf_dir):
    hours = _orders(warehouse(spark, sf_dir)).groupBy(HOUR).agg(F.count(F.lit(1)).alias("orders"))
    most = F.max("orders").over(Window.partitionBy())
    return hours.withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("orders") * 60 / most).cast("int")))


def daypart_shares(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    joined = _orders(w).join(_current_stores(w), F.col("store_id") == F.col("s"))
    return joined.groupBy("store_type").agg(_share(F.col(HOUR).between(7, 8)).alias("pct_07_09"), _share(F.col(HOUR).between(18, 19)).alias("pct_18_20"))


def weekday_weekend(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    days = _orders(w).join(_current_stores(w), F.col("store_id") == F.col("s")).groupBy("store_type", "store_id", "local_day").agg(F.count(F.lit(1)).alias("n"))
    weekend = F.dayofweek("local_day").isin(1, 7)
    avg = lambda c: ratio(F.sum(F.when(c, F.col("n"))), F.count(F.when(c, 1)))
    out = days.groupBy("store_type").agg(avg(~weekend).alias("weekday_avg"), avg(weekend).alias("weekend_avg"))
    return out.withColumn("weekend_index", ratio(F.col("weekend_avg"), F.col("weekday_avg")))


def payday(spark, sf_dir):
    daily = _orders(warehouse(spark, sf_dir)).filter("order_status <> 'cancelled'").groupBy("local_day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("subtotal") - F.col("discount_amount")).alias("net"))
    day = F.dayofmonth("local_day")
    kind = F.when(day.isin(1, 15, 16) | (F.col("local_day") == F.last_day("local_day")), "payday window").otherwise("other days")
    return daily.groupBy(kind.alias("day_type")).agg(F.count(F.lit(1)).alias("days"), ratio(F.sum("n"), F.count(F.lit(1))).alias("avg_orders"), ratio(F.sum("net"), F.count(F.lit(1))).alias("avg_net_sales"))


def monthly_orders(spark, sf_dir):
    months = _orders(warehouse(spark, sf_dir)).groupBy(F.trunc("local_day", "month").alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("local_day").alias("active_days"))
    return months.withColumn("orders_per_day", ratio(F.col("orders"), F.col("active_days")))


def walk_in_share(spark, sf_dir):
    return _orders(warehouse(spark, sf_dir)).agg(_share(F.col("customer_id").isNull()).alias("walk_in_pct"))


def _per_customer(w) -> DataFrame:
    return w.latest("orders").filter("customer_id is not null").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


def repeat_buckets(spark, sf_dir):
    n = F.col("n")
    bucket = F.when(n == 1, "1 order").when(n <= 3, "2-3 orders").when(n <= 9, "4-9 orders").when(n <= 24, "10-24 orders").otherwise("25+ orders")
    grouped = _per_customer(warehouse(spark, sf_dir)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"))
    return share_of_total(grouped, "orders", "pct_of_orders")


def top_decile_share(spark, sf_dir):
    ranked = tiles_by_selection(settle(_per_customer(warehouse(spark, sf_dir))), 10, "customer_id", {"decile": -F.col("n")})
    return ranked.agg(ratio(F.lit(100) * F.sum(F.when(F.col("decile") == 1, F.col("n"))), F.sum("n")).alias("top_decile_pct"))


def members_without_orders(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    without = w.dim_customer.join(w.latest("orders").select("customer_id").filter("customer_id is not null").distinct().withColumn("seen", F.lit(1)), "customer_id", "left")
    return without.agg(_share(F.col("seen").isNull()).alias("no_orders_pct"))


def _units(w) -> DataFrame:
    return w.latest("order_items").groupBy("product_id").agg(F.sum("quantity").alias("units"))


def top_products(spark, sf_dir):
    units = _units(warehouse(spark, sf_dir))
    whole = units.agg(F.sum("units").alias("all_units"))
    return units.join(F.broadcast(whole)).withColumn("pct_units", ratio(F.lit(100) * F.col("units"), F.col("all_units"))).drop("all_units").orderBy(F.desc("units"), "product_id").limit(10)


def top_fifth_products(spark, sf_dir):
    ranked = tiles_by_selection(settle(_units(warehouse(spark, sf_dir))), 5, "product_id", {"fifth": -F.col("units")})
    return ranked.agg(ratio(F.lit(100) * F.sum(F.when(F.col("fifth") == 1, F.col("units"))), F.sum("units")).alias("top_fifth_pct"))


def category_by_daypart(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    categories = w.dim_product.filter("is_current").select(F.col("product_id").alias("p"), "category_name")
    lines = w.latest("order_items").select("order_id", "product_id", "quantity").join(_orders(w).select("order_id", HOUR), "order_id").join(categories, F.col("product_id") == F.col("p"))
    part = F.when(F.col(HOUR) < 11, "1 morning").when(F.col(HOUR) < 14, "2 lunch").when(F.col(HOUR) < 18, "3 afternoon").otherwise("4 evening")
    grouped = lines.groupBy("category_name", part.alias("daypart")).agg(F.sum("quantity").alias("units"))
    return share_of_total(grouped, "units", "pct", ["daypart"])


def basket_sizes(spark, sf_dir):
    lines = warehouse(spark, sf_dir).latest("order_items").groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
    return share_of_total(lines.groupBy("lines").agg(F.count(F.lit(1)).alias("orders")), "orders", "pct")


def quantities(spark, sf_dir):
    """How many lines have which quantity."""
    return share_of_total(warehouse(spark, sf_dir).latest("order_items").groupBy("quantity").agg(F.count(F.lit(1)).alias("lines")), "lines", "pct")


def promotion_mix(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    promos = w.dim_promotion.select("promotion_id", "promo_type", F.split_part("promo_name", F.lit(" "), F.lit(1)).alias("campaign"))
    lines = w.latest("order_items").groupBy(F.col("order_id").alias("o")).agg(F.sum("line_discount").alias("line_discount"))
    joined = w.latest("orders").join(promos, "promotion_id", "left").join(lines, F.col("order_id") == F.col("o"), "left")
    return plain(joined.groupBy("promo_type", "campaign").agg(F.count(F.lit(1)).alias("orders"), F.sum("discount_amount").alias("order_discount"), F.coalesce(F.sum("line_discount"), F.lit(0)).alias("line_discount")))


def tender_mix(spark, sf_dir):
    grouped = warehouse(spark, sf_dir).latest("payments").groupBy("payment_method", "payment_status").agg(F.count(F.lit(1)).alias("payments"))
    return share_of_total(grouped, "payments", "pct")


def split_tenders(spark, sf_dir):
    return warehouse(spark, sf_dir).latest("payments").groupBy("order_id").agg(F.count(F.lit(1)).alias("payments")).filter("payments > 1")


def primary_tender(spark, sf_dir):
    """The method of an order's largest paid payment, the smallest id among equals."""
    paid = warehouse(spark, sf_dir).latest("payments").filter("payment_status = 'paid'")
    return paid.groupBy("order_id").agg(F.max_by("payment_method", F.struct("amount", -F.col("payment_id"))).alias("method"))


def status_mix(spark, sf_dir):
    grouped = warehouse(spark, sf_dir).latest("orders").groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))
    return share_of_total(grouped, "orders", "pct")


def update_ranges(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    tables = [t for t, c in CONTRACTS.items() if c.cursor]
    frames = [w.silver(t).agg(F.lit(t).alias("table_name"), F.min("updated_at").alias("first_update"), F.max("updated_at").alias("last_update")) for t in tables]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def recent_writes(spark, sf_dir, days: int = 7):
    """Versions of each table within so many days of the table's newest."""
    w = warehouse(spark, sf_dir)
    out = None
    for t in (t for t, c in CONTRACTS.items() if c.cursor):
        versions = w.silver(t).select("updated_at")
        newest = versions.agg(F.max("updated_at").alias("newest"))
        recent = versions.join(F.broadcast(newest)).filter(F.col("updated_at") > F.expr(f"newest - make_dt_interval({days})"))
        row = recent.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("recent"))
        out = row if out is None else out.unionByName(row)
    return out


def latest_update_dates(spark, sf_dir):
    days = warehouse(spark, sf_dir).silver("orders").groupBy(local_date("updated_at").alias("day")).agg(F.count(F.lit(1)).alias("versions"))
    return days.orderBy(F.desc("day")).limit(5)


def update_lag(spark, sf_dir):
    versions = warehouse(spark, sf_dir).silver("orders")
    same = local_date("updated_at") == local_date("order_ts")
    return versions.agg(F.count_if(same).alias("same_day"), F.count_if(~same).alias("later"))


def change_counters(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    one = lambda df, name: df.agg(F.lit(name).alias("counter"), F.count(F.lit(1)).alias("n"))
    tiers = w.dim_customer.groupBy(F.concat(F.lit("tier "), "loyalty_tier").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return one(w.latest("orders").filter("order_status = 'refunded'"), "refunds").unionByName(one(w.dim_store.filter("is_current and status = 'closed'"), "closed stores")).unionByName(tiers)


def changed_rows(spark, sf_dir):
    """Counters of changes: versions after the first of their key, for each table."""
    w = warehouse(spark, sf_dir)
    out = None
    for t, c in CONTRACTS.items():
        if c.cursor:
            row = w.silver(t).agg(F.lit(t).alias("table_name"), (F.count(F.lit(1)) - F.countDistinct(c.key)).alias("changes"))
            out = row if out is None else out.unionByName(row)
    return out


def stores_changed(spark, sf_dir):
    return warehouse(spark, sf_dir).dim_store.filter("cast(valid_from as date) > opened_date").select("store_id", "store_name", "status", "valid_from")


def openings(spark, sf_dir):
    """Stores that opened after the first sale of the chain, with their own first sale."""
    w = warehouse(spark, sf_dir)
    first = w.latest("orders").groupBy(F.col("store_id").alias("o")).agg(F.min(local_date("order_ts")).alias("first_sale"))
    chain = w.latest("orders").agg(F.min(local_date("order_ts")).alias("chain_first"))
    stores = _current_stores(w).join(F.broadcast(chain)).filter("opened_date > chain_first")
    return stores.join(first, F.col("s") == F.col("o"), "left").select(F.col("s").alias("store_id"), "opened_date", "first_sale")


def launches(spark, sf_dir):
    """Products launched after the first sale of the chain, with their own first sale."""
    w = warehouse(spark, sf_dir)
    lines = w.fct_order_items.groupBy(F.col("product_id").alias("p")).agg(F.min("business_date").alias("first_sale"))
    chain = w.fct_orders.agg(F.min("business_date").alias("chain_first"))
    current = w.dim_product.filter("is_current").select("product_id", "launched_date")
    return current.join(F.broadcast(chain)).filter("launched_date > chain_first").join(lines, F.col("product_id") == F.col("p"), "left").select("product_id", "launched_date", "first_sale")


def ads_by_region_pivot(spark, sf_dir):
    """Average daily sales by day, a column for each region of the table."""
    p = warehouse(spark, sf_dir).store_performance
    regions = [r["r_name"] for r in read_table(spark, sf_dir, "region").select("r_name", "r_regionkey").orderBy("r_regionkey").collect()]
    made = [ratio(F.sum(F.when(F.col("region_name") == r, F.col("total_sales"))), F.countDistinct(F.when(F.col("region_name") == r, F.col("store_day_key")))).alias(f"region_{i}") for i, r in enumerate(regions)]
    return p.groupBy("business_date").agg(*made)


def cohort_pivot(spark, sf_dir, months: tuple[int, ...] = (0, 1, 2, 3)):
    c = warehouse(spark, sf_dir).customer_cohorts
    made = [F.max(F.when(F.col("month_number") == m, F.col("retention_rate"))).alias(f"m{m}") for m in months]
    return c.groupBy("cohort_month").agg(F.max("cohort_size").alias("cohort_size"), *made)


def cohort_pivot_all(spark, sf_dir):
    """Retention of every month that any cohort has; the months, some eighty, come from the data."""
    months = [r[0] for r in warehouse(spark, sf_dir).customer_cohorts.select("month_number").distinct().orderBy("month_number").collect()]
    return cohort_pivot(spark, sf_dir, tuple(months))


def sellable_products(spark, sf_dir):
    """For each business day and category the products that may be sold: active, and launched by then.

    Launches are summed by category and day first, so the running sum goes over days, not over products and days.
    """
    w = warehouse(spark, sf_dir)
    days = w.dim_date.select("calendar_date")
    first = days.agg(F.min("calendar_date").alias("first"))
    current = w.dim_product.filter("is_current and is_active").join(F.broadcast(first)).select("category_name", F.greatest("launched_date", "first").alias("since"))
    launched = current.groupBy("category_name", "since").agg(F.count(F.lit(1)).alias("n"))
    grid = launched.select(F.col("category_name").alias("c")).distinct().join(F.broadcast(days))
    joined = grid.join(launched, (F.col("c") == F.col("category_name")) & (F.col("calendar_date") == F.col("since")), "left")
    running = F.sum("n").over(Window.partitionBy("c").orderBy("calendar_date").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("calendar_date", F.col("c").alias("category_name"), F.coalesce(running, F.lit(0)).alias("sellable_products"))


def status_amounts(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    side = lambda df, kind, status, amount: df.groupBy(F.lit(kind).alias("kind"), F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).cast("double").alias("amount"))
    return side(w.fct_orders, "order", "order_status", "total_amount").unionByName(side(w.fct_payments, "payment", "payment_status", "amount"))


def company_and_customers(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    company = w.executive_daily.agg(F.sum("total_sales").cast("double").alias("company_sales"))
    known = w.customer_rfm.agg(F.sum("monetary").cast("double").alias("customer_sales"))
    return company.join(F.broadcast(known)).withColumn("share", ratio(F.col("customer_sales"), F.col("company_sales")))


def region_inversions(spark, sf_dir):
    p = warehouse(spark, sf_dir).store_performance
    by = p.groupBy("area_name").agg(F.sum("total_sales").alias("sales"), ratio(F.sum("total_sales"), F.countDistinct("store_day_key")).alias("ads"))
    return rank_inversions(by, "area_name", "sales", "ads")


def product_inversions(spark, sf_dir):
    """For each product how many that sold fewer units brought in more."""
    sold = warehouse(spark, sf_dir).fct_order_items.groupBy("product_id").agg(F.sum("quantity").alias("units"), F.sum("line_total").alias("sales"))
    return inversion_counts(sold, "product_id", F.col("units"), cents("sales"))


def tier_upgrades(spark, sf_dir, day: str = "1998-06-30"):
    """Customers with an order on the day whose net spend of 365 days reaches a higher tier than they have."""
    w = warehouse(spark, sf_dir)
    orders = _orders(w).filter("customer_id is not null")
    d = F.lit(day).cast("date")
    active = orders.filter(F.col("local_day") == d).select("customer_id").distinct()
    spend = orders.filter((F.col("order_status") == "completed") & F.col("local_day").between(F.date_sub(d, 364), d)).join(active, "customer_id", "left_semi")
    spend = spend.groupBy("customer_id").agg(F.sum(F.col("total_amount") - F.col("tax_amount")).alias("spend"))
    tiers = F.array(*map(F.lit, ("basic", "silver", "gold", "platinum")))
    target = F.when(F.col("spend") >= 15_000, "platinum").when(F.col("spend") >= 7_000, "gold").when(F.col("spend") >= 2_500, "silver").otherwise("basic")
    joined = spend.withColumn("tier", target).join(w.dim_customer.select("customer_id", "loyalty_tier"), "customer_id")
    return joined.filter(F.array_position(tiers, F.col("tier")) > F.array_position(tiers, F.col("loyalty_tier"))).select("customer_id", F.col("loyalty_tier").alias("old_tier"), F.col("tier").alias("new_tier"), F.col("spend").cast("double").alias("spend"))


def promotion_violations(spark, sf_dir):
    """Orders that used a promotion outside its days."""
    w = warehouse(spark, sf_dir)
    promos = w.dim_promotion.select("promotion_id", "start_date", "end_date")
    return w.fct_orders.join(promos, "promotion_id").filter(~F.col("business_date").between(F.col("start_date"), F.col("end_date"))).select("order_id", "promotion_id", "business_date")


QUERIES = {
    "pt01_row_counts": row_counts, "pt02_store_types": store_type_profile, "pt03_hours": orders_by_hour, "pt04_daypart_shares": daypart_shares, "pt05_weekend": weekday_weekend,
    "pt06_payday": payday, "pt07_months": monthly_orders, "pt08_walk_in": walk_in_share, "pt09_repeat": repeat_buckets, "pt10_top_decile": top_decile_share,
    "pt11_no_orders": members_without_orders, "pt12_top_products": top_products, "pt13_top_fifth": top_fifth_products, "pt14_category_daypart": category_by_daypart,
    "pt15_baskets": basket_sizes, "pt16_promotions": promotion_mix, "pt17_tenders": tender_mix, "pt17_split_tenders": split_tenders, "pt18_statuses": status_mix,
    "pt20_update_ranges": update_ranges, "pt21_latest_updates": latest_update_dates, "pt21_update_lag": update_lag, "pt22_counters": change_counters, "pt23_changed_stores": stores_changed,
    "pt24_openings": openings, "bi25_region_pivot": ads_by_region_pivot, "bi41_cohort_pivot": cohort_pivot, "bi41_cohort_all_months": cohort_pivot_all, "in1_statuses": status_amounts, "in3_company_customers": company_and_customers,
    "win10_inversions": region_inversions, "win10_products": product_inversions, "jon16_primary_tender": primary_tender, "jon17_promotion_violations": promotion_violations, "tir1_upgrades": tier_upgrades,
    "pt15_quantities": quantities, "pt20_recent_writes": recent_writes, "pt22_changed_rows": changed_rows, "pt24_launches": launches, "flt7_sellable_products": sellable_products, "flt7_trading_days": lambda spark, sf_dir: warehouse(spark, sf_dir).trading_calendar,
}

_TABLES = tuple(CONTRACTS)
_VERSIONED = tuple(t for t, c in CONTRACTS.items() if c.cursor)
_O = f"o AS (SELECT *, (order_ts + INTERVAL {ZONE_HOURS} HOUR)::DATE AS local_day, hour(order_ts + INTERVAL {ZONE_HOURS} HOUR) AS hour FROM l_orders)"
_ST = "st AS (SELECT store_id, store_type, store_name, opened_date FROM dim_store WHERE is_current)"
_PC = "c AS (SELECT customer_id, count(*) AS n FROM l_orders WHERE customer_id IS NOT NULL GROUP BY 1)"
_U = "u AS (SELECT product_id, sum(quantity)::BIGINT AS units FROM l_order_items GROUP BY 1)"
_BUCKET = "CASE WHEN n = 1 THEN '1 order' WHEN n <= 3 THEN '2-3 orders' WHEN n <= 9 THEN '4-9 orders' WHEN n <= 24 THEN '10-24 orders' ELSE '25+ orders' END"
_PCT = "100.0::DOUBLE * {0}::DOUBLE / (sum({0}) OVER ({1}))::DOUBLE"


def _with(parts: str, select: str) -> str:
    return over_warehouse(f", {parts} {select}")


SQL = {
    "pt01_row_counts": over_warehouse(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM s_{t}" for t in _TABLES)),
    "pt02_store_types": _with(f"{_O}, {_ST}, un AS (SELECT order_id, sum(quantity) AS units FROM l_order_items GROUP BY 1)", "SELECT store_type, count(*) AS orders, count(*)::DOUBLE / count(DISTINCT (store_id, local_day)) AS orders_per_store_day, sum(subtotal - discount_amount)::DOUBLE / count(*) AS aov_net, sum(units)::DOUBLE / count(units) AS units_per_order, 100.0::DOUBLE * count(*) FILTER (customer_id IS NULL) / count(*) AS walk_in_pct FROM o JOIN st USING (store_id) LEFT JOIN un USING (order_id) WHERE order_status <> 'cancelled' GROUP BY 1"),
    "pt03_hours": _with(_O, "SELECT hour::BIGINT AS hour, count(*) AS orders, repeat('#', floor(count(*) * 60 / max(count(*)) OVER ())::INT) AS bar FROM o GROUP BY 1"),
    "pt04_daypart_shares": _with(f"{_O}, {_ST}", "SELECT store_type, 100.0::DOUBLE * count(*) FILTER (hour BETWEEN 7 AND 8) / count(*) AS pct_07_09, 100.0::DOUBLE * count(*) FILTER (hour BETWEEN 18 AND 19) / count(*) AS pct_18_20 FROM o JOIN st USING (store_id) GROUP BY 1"),
    "pt05_weekend": _with(f"{_O}, {_ST}, d AS (SELECT store_type, store_id, local_day, count(*) AS n FROM o JOIN st USING (store_id) GROUP BY ALL), e AS (SELECT store_type, sum(n) FILTER (isodow(local_day) < 6)::DOUBLE / count(*) FILTER (isodow(local_day) < 6) AS weekday_avg, sum(n) FILTER (isodow(local_day) >= 6)::DOUBLE / count(*) FILTER (isodow(local_day) >= 6) AS weekend_avg FROM d GROUP BY 1)", "SELECT *, weekend_avg / weekday_avg AS weekend_index FROM e"),
    "pt06_payday": _with(f"{_O}, d AS (SELECT local_day, count(*) AS n, sum(subtotal - discount_amount) AS net FROM o WHERE order_status <> 'cancelled' GROUP BY 1)", "SELECT CASE WHEN day(local_day) IN (1, 15, 16) OR local_day = last_day(local_day) THEN 'payday window' ELSE 'other days' END AS day_type, count(*) AS days, sum(n)::DOUBLE / count(*) AS avg_orders, sum(net)::DOUBLE / count(*) AS avg_net_sales FROM d GROUP BY 1"),
    "pt07_months": _with(_O, "SELECT date_trunc('month', local_day)::DATE AS month, count(*) AS orders, count(DISTINCT local_day) AS active_days, count(*)::DOUBLE / count(DISTINCT local_day) AS orders_per_day FROM o GROUP BY 1"),
    "pt08_walk_in": over_warehouse("SELECT 100.0::DOUBLE * count(*) FILTER (customer_id IS NULL) / count(*) AS walk_in_pct FROM l_orders"),
    "pt09_repeat": _with(_PC, f"SELECT {_BUCKET} AS bucket, count(*) AS customers, sum(n)::BIGINT AS orders, 100.0::DOUBLE * sum(n)::DOUBLE / (sum(sum(n)) OVER ())::DOUBLE AS pct_of_orders FROM c GROUP BY 1"),
    "pt10_top_decile": _with(f"{_PC}, t AS (SELECT n, ntile(10) OVER (ORDER BY n DESC, customer_id) AS d FROM c)", "SELECT 100.0::DOUBLE * sum(n) FILTER (d = 1)::DOUBLE / sum(n)::DOUBLE AS top_decile_pct FROM t"),
    "pt11_no_orders": over_warehouse("SELECT 100.0::DOUBLE * count(*) FILTER (customer_id NOT IN (SELECT customer_id FROM l_orders WHERE customer_id IS NOT NULL)) / count(*) AS no_orders_pct FROM dim_customer"),
    "pt12_top_products": _with(_U, "SELECT product_id, units, 100.0::DOUBLE * units::DOUBLE / (SELECT sum(units) FROM u)::DOUBLE AS pct_units FROM u ORDER BY units DESC, product_id LIMIT 10"),
    "pt13_top_fifth": _with(f"{_U}, t AS (SELECT units, ntile(5) OVER (ORDER BY units DESC, product_id) AS q FROM u)", "SELECT 100.0::DOUBLE * sum(units) FILTER (q = 1)::DOUBLE / sum(units)::DOUBLE AS top_fifth_pct FROM t"),
    "pt14_category_daypart": _with(f"{_O}, x AS (SELECT category_name, CASE WHEN hour < 11 THEN '1 morning' WHEN hour < 14 THEN '2 lunch' WHEN hour < 18 THEN '3 afternoon' ELSE '4 evening' END AS daypart, sum(quantity)::BIGINT AS units FROM l_order_items i JOIN o USING (order_id) JOIN dim_product p ON p.product_id = i.product_id AND is_current GROUP BY ALL)", f"SELECT *, {_PCT.format('units', 'PARTITION BY daypart')} AS pct FROM x"),
    "pt15_baskets": _with("b AS (SELECT lines, count(*) AS orders FROM (SELECT order_id, count(*) AS lines FROM l_order_items GROUP BY 1) GROUP BY 1)", f"SELECT *, {_PCT.format('orders', '')} AS pct FROM b"),
    "pt15_quantities": _with("b AS (SELECT quantity, count(*) AS lines FROM l_order_items GROUP BY 1)", f"SELECT *, {_PCT.format('lines', '')} AS pct FROM b"),
    "pt20_recent_writes": over_warehouse(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS recent FROM s_{t} WHERE updated_at > (SELECT max(updated_at) FROM s_{t}) - INTERVAL 7 DAY" for t in _VERSIONED)),
    "pt22_changed_rows": over_warehouse(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) - count(DISTINCT {CONTRACTS[t].key}) AS changes FROM s_{t}" for t in _VERSIONED)),
    "pt24_launches": over_warehouse(", f AS (SELECT product_id, min(business_date) AS first_sale FROM fct_order_items GROUP BY 1), p AS (SELECT product_id, DATE '1994-12-01' + (product_id % 400)::INT AS launched_date FROM dim_product WHERE is_current) SELECT product_id, launched_date, first_sale FROM p LEFT JOIN f USING (product_id) WHERE launched_date > (SELECT min(business_date) FROM fct_orders)"),
    "flt7_sellable_products": over_warehouse(", l AS (SELECT p_type AS category_name, DATE '1994-12-01' + (p_partkey % 400)::INT AS launched FROM part) SELECT d AS calendar_date, c.category_name, (SELECT count(*) FROM l WHERE l.category_name = c.category_name AND launched <= d) AS sellable_products FROM days, (SELECT DISTINCT category_name FROM l) c"),
    "flt7_trading_days": over_warehouse("SELECT c.* FROM store_calendar c JOIN dim_store USING (store_sk) WHERE status NOT IN ('closed', 'temporarily_closed')"),
    "pt16_promotions": _with("li AS (SELECT order_id, sum(line_discount) AS line_discount FROM l_order_items GROUP BY 1)", "SELECT promo_type, split_part(promo_name, ' ', 1) AS campaign, count(*) AS orders, sum(discount_amount)::DOUBLE AS order_discount, coalesce(sum(line_discount), 0)::DOUBLE AS line_discount FROM l_orders LEFT JOIN dim_promotion USING (promotion_id) LEFT JOIN li USING (order_id) GROUP BY 1, 2"),
    "pt17_tenders": _with("b AS (SELECT payment_method, payment_status, count(*) AS payments FROM l_payments GROUP BY ALL)", f"SELECT *, {_PCT.format('payments', '')} AS pct FROM b"),
    "pt17_split_tenders": over_warehouse("SELECT order_id, count(*) AS payments FROM l_payments GROUP BY 1 HAVING count(*) > 1"),
    "pt18_statuses": _with("b AS (SELECT order_status, count(*) AS orders FROM l_orders GROUP BY ALL)", f"SELECT *, {_PCT.format('orders', '')} AS pct FROM b"),
    "pt20_update_ranges": over_warehouse(" UNION ALL ".join(f"SELECT '{t}' AS table_name, min(updated_at) AS first_update, max(updated_at) AS last_update FROM s_{t}" for t in _VERSIONED)),
    "pt21_latest_updates": over_warehouse(f"SELECT (updated_at + INTERVAL {ZONE_HOURS} HOUR)::DATE AS day, count(*) AS versions FROM s_orders GROUP BY 1 ORDER BY 1 DESC LIMIT 5"),
    "pt21_update_lag": over_warehouse(f"SELECT count(*) FILTER ((updated_at + INTERVAL {ZONE_HOURS} HOUR)::DATE = (order_ts + INTERVAL {ZONE_HOURS} HOUR)::DATE) AS same_day, count(*) FILTER ((updated_at + INTERVAL {ZONE_HOURS} HOUR)::DATE <> (order_ts + INTERVAL {ZONE_HOURS} HOUR)::DATE) AS later FROM s_orders"),
    "pt22_counters": over_warehouse("SELECT 'refunds' AS counter, count(*) AS n FROM l_orders WHERE order_status = 'refunded' UNION ALL SELECT 'closed stores', count(*) FROM dim_store WHERE is_current AND status = 'closed' UNION ALL SELECT 'tier ' || loyalty_tier, count(*) FROM dim_customer GROUP BY 1"),
    "pt23_changed_stores": over_warehouse("SELECT store_id, store_name, status, valid_from FROM dim_store WHERE valid_from::DATE > opened_date"),
    "pt24_openings": _with(f"{_O}, {_ST}, f AS (SELECT store_id, min(local_day) AS first_sale FROM o GROUP BY 1)", "SELECT store_id, opened_date, first_sale FROM st LEFT JOIN f USING (store_id) WHERE opened_date > (SELECT min(local_day) FROM o)"),
    "bi25_region_pivot": _with("rg AS (SELECT region_name, row_number() OVER (ORDER BY region_id) - 1 AS i FROM s_regions)", "SELECT business_date, " + ", ".join(f"sum(total_sales) FILTER (i = {i})::DOUBLE / nullif(count(DISTINCT store_day_key) FILTER (i = {i}), 0) AS region_{i}" for i in range(5)) + " FROM store_performance JOIN rg USING (region_name) GROUP BY 1"),
    "bi41_cohort_all_months": over_warehouse(", c AS (SELECT cohort_month, 'm' || month_number AS m, retention_rate, max(cohort_size) OVER (PARTITION BY cohort_month) AS cohort_size FROM customer_cohorts) SELECT * FROM (PIVOT c ON m USING max(retention_rate) GROUP BY cohort_month, cohort_size)"),
    "bi41_cohort_pivot": over_warehouse("SELECT cohort_month, max(cohort_size) AS cohort_size, " + ", ".join(f"max(retention_rate) FILTER (month_number = {m}) AS m{m}" for m in range(4)) + " FROM customer_cohorts GROUP BY 1"),
    "in1_statuses": over_warehouse("SELECT 'order' AS kind, order_status AS status, count(*) AS n, sum(total_amount)::DOUBLE AS amount FROM fct_orders GROUP BY ALL UNION ALL SELECT 'payment', payment_status, count(*), sum(amount)::DOUBLE FROM fct_payments GROUP BY ALL"),
    "in3_company_customers": over_warehouse("SELECT company_sales, customer_sales, customer_sales / company_sales AS share FROM (SELECT sum(total_sales)::DOUBLE AS company_sales FROM executive_daily), (SELECT sum(monetary)::DOUBLE AS customer_sales FROM customer_rfm)"),
    "win10_products": over_warehouse(", t AS MATERIALIZED (SELECT product_id, sum(quantity) AS units, sum(line_total) AS sales FROM fct_order_items GROUP BY 1) SELECT a.product_id, count(b.product_id) AS overtaken_by FROM t a LEFT JOIN t b ON a.units > b.units AND a.sales < b.sales GROUP BY 1"),
    "win10_inversions": _with("g AS (SELECT area_name, rank() OVER (ORDER BY sum(total_sales) DESC) AS r1, rank() OVER (ORDER BY sum(total_sales)::DOUBLE / count(DISTINCT store_day_key) DESC) AS r2 FROM store_performance GROUP BY 1)", "SELECT a.area_name AS higher, b.area_name AS lower FROM g a JOIN g b ON a.r1 < b.r1 AND a.r2 > b.r2"),
    "jon16_primary_tender": over_warehouse("SELECT order_id, payment_method AS method FROM l_payments WHERE payment_status = 'paid' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY amount DESC, payment_id) = 1"),
    "jon17_promotion_violations": over_warehouse("SELECT order_id, promotion_id, business_date FROM fct_orders JOIN dim_promotion USING (promotion_id) WHERE business_date NOT BETWEEN start_date AND end_date"),
    "tir1_upgrades": _with(f"{_O}, sp AS (SELECT customer_id, sum(total_amount - tax_amount)::DOUBLE AS spend FROM o WHERE order_status = 'completed' AND local_day BETWEEN DATE '1998-06-30' - 364 AND DATE '1998-06-30' AND customer_id IN (SELECT customer_id FROM o WHERE local_day = DATE '1998-06-30' AND customer_id IS NOT NULL) GROUP BY 1), tg AS (SELECT *, CASE WHEN spend >= 15000 THEN 'platinum' WHEN spend >= 7000 THEN 'gold' WHEN spend >= 2500 THEN 'silver' ELSE 'basic' END AS new_tier FROM sp)", "SELECT customer_id, loyalty_tier AS old_tier, new_tier, spend FROM tg JOIN dim_customer USING (customer_id) WHERE list_position(['basic', 'silver', 'gold', 'platinum'], new_tier) > list_position(['basic', 'silver', 'gold', 'platinum'], loyalty_tier)"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, q=q: plain(q(spark, sf_dir))) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

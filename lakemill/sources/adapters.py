"""The driver's star-schema tables as versions of the ten source tables, with replay copies.

Times are UTC instants without a zone; the business day is eight hours ahead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.sources.contracts import CONTRACTS, Contract
from lakemill.sources.tables import read_source

#: Business time is so many hours ahead of UTC, without summer time.
ZONE_HOURS = 8
LATE_MINUTES = 60

#: The driver's tables as they are declared; no footer is opened to find a schema, and a file of another type is an error when it is read.
DECLARED = {
    c.name: c
    for c in (
        Contract("region", "r_regionkey int, r_name string", "r_regionkey", None),
        Contract("nation", "n_nationkey int, n_name string, n_regionkey int", "n_nationkey", None),
        Contract("customer", "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string", "c_custkey", None),
        Contract("supplier", "s_suppkey bigint, s_name string, s_nationkey int", "s_suppkey", None),
        Contract("part", "p_partkey bigint, p_name string, p_type string, p_retailprice double", "p_partkey", None),
        Contract("orders", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz", "o_orderkey", None),
        Contract("lineitem", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz", "l_orderkey", None),
    )
}

_SELECTS = {
    "regions": ("region", "cast(r_regionkey as bigint) region_id, r_name region_name", ""),
    "areas": ("nation", "cast(n_nationkey as bigint) area_id, cast(n_regionkey as bigint) region_id, n_name area_name", ""),
    "stores": (
        "supplier",
        """s_suppkey store_id, cast((s_nationkey + k) % 25 as bigint) area_id, concat('S', s_suppkey) store_code, s_name store_name,
        element_at(array('mall', 'street', 'office', 'drive_thru', 'kiosk'), cast(s_suppkey % 5 as int) + 1) store_type, concat('City ', (s_nationkey + k) % 25) city,
        date_add(date'1994-12-01', cast(s_suppkey % 400 as int)) opened_date, case when k = 1 and s_suppkey % 17 = 16 then date'2000-06-30' end closed_date,
        case when k = 1 and s_suppkey % 17 = 16 then 'closed' else 'active' end status,
        timestamp_ntz'1994-11-01 00:00:00' + make_dt_interval(cast(k * (1150 + s_suppkey % 30) as int), 0, 0, k * 54000) updated_at""",
        "0, 1",
    ),
    "products": (
        "part",
        """p_partkey product_id, element_at(map('ECONOMY', 1L, 'LARGE', 2L, 'MEDIUM', 3L, 'PROMO', 4L, 'SMALL', 5L, 'STANDARD', 6L), p_type) category_id, concat('P', p_partkey) sku, p_name product_name,
        cast(p_retailprice as decimal(12,2)) base_price, cast(cast(p_retailprice as decimal(12,2)) - 500 + 10 * k as decimal(12,2)) unit_cost, true is_active, date_add(date'1994-12-01', cast(p_partkey % 400 as int)) launched_date,
        timestamp_ntz'1994-12-01 00:00:00' + make_dt_interval(cast(800 * k + p_partkey % 200 as int)) updated_at""",
        "0, 1, 2",
    ),
    "customers": (
        "customer",
        """c_custkey customer_id, c_name full_name, concat('City ', c_nationkey) city, date'1994-06-01' signup_date,
        case when k = 0 then 'basic' when c_mktsegment = 'AUTOMOBILE' then 'silver' when c_mktsegment = 'BUILDING' then 'gold' when c_mktsegment = 'FURNITURE' then 'platinum' else 'basic' end loyalty_tier,
        timestamp_ntz'1994-12-01 00:00:00' + make_dt_interval(k * 548) updated_at""",
        "0, 1",
    ),
    "promotions": (
        "nation",
        """cast(n_nationkey as bigint) promotion_id, concat('PROMO', n_nationkey) promo_code, concat('Campaign ', n_nationkey) promo_name, element_at(array('percent', 'fixed', 'bundle'), n_nationkey % 3 + 1) promo_type,
        cast(5 + n_nationkey as decimal(12,2)) discount_value, date_add(date'1995-01-01', 90 * n_nationkey) start_date, date_add(date'1995-01-01', 90 * n_nationkey + 60) end_date, timestamp_ntz'1994-12-01 00:00:00' updated_at""",
        "",
    ),
    "orders": (
        "orders",
        """o_orderkey order_id, o_orderkey % stores store_id, case when o_orderkey % 3 <> 0 then o_custkey end customer_id, case when o_orderkey % 7 = 0 then o_orderkey % 25 end promotion_id,
        o_orderdate + make_dt_interval(0, 0, 0, cast((o_orderkey * 7919) % 86400 as int)) order_ts, element_at(array('dine_in', 'takeaway', 'delivery'), cast(o_orderkey % 3 as int) + 1) order_channel,
        case when o_orderkey % 50 = 0 then 'cancelled' when k = 1 then 'refunded' else 'completed' end order_status,
        cast(o_totalprice as decimal(12,2)) subtotal, cast(0 as decimal(12,2)) discount_amount, cast(0 as decimal(12,2)) tax_amount, cast(o_totalprice as decimal(12,2)) total_amount,
        o_orderdate + make_dt_interval(2 * k, 0, 0, cast((o_orderkey * 7919) % 86400 as int)) updated_at""",
        "0, 1",
    ),
    "order_items": (
        "lineitem",
        """l_orderkey * 10 + l_linenumber order_item_id, l_orderkey order_id, l_partkey product_id, l_suppkey supplier_id, cast(l_quantity as bigint) quantity,
        cast(cast(l_extendedprice as decimal(12,2)) / cast(l_quantity as int) as decimal(12,2)) unit_price, cast(0 as decimal(12,2)) line_discount, cast(l_extendedprice as decimal(12,2)) line_total, l_shipdate updated_at""",
        "",
    ),
}


def _declared(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_source(spark, f"{sf_dir}/{table}.parquet", DECLARED[table])


def _versions(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    source, columns, versions = _SELECTS[table]
    df = _declared(spark, sf_dir, source)
    if table == "orders":
        #: One row: stores are numbered from 0, and orders spread over them.
        stores = _declared(spark, sf_dir, "supplier").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("stores"))
        df = df.join(F.broadcast(stores))
    if versions:
        df = df.selectExpr("*", f"explode(array({versions})) k")
        if table == "orders":
            df = df.filter("k = 0 or (o_orderkey % 50 <> 0 and o_orderstatus = 'P' and o_orderkey % 4 = 0)")
    return df.select(*map(F.expr, _parts(columns)))


def _parts(columns: str) -> list[str]:
    """Columns of a select list; commas inside brackets do not part them."""
    parts, depth, held = [], 0, ""
    for ch in " ".join(columns.split()):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(held)
            held = ""
        else:
            held += ch
    return [*parts, held]


def payments(orders: DataFrame) -> DataFrame:
    """One paid row an order, one refunded row for a refund, one failed row for every eightieth order."""
    method = "element_at(array('cash', 'card', 'e_wallet'), cast(order_id % 3 as int) + 1)"
    refund = "order_status = 'refunded'"
    kinds = f"array_compact(array(if({refund}, struct(2 n, 'refunded' s), struct(1 n, 'paid' s)), if(not {refund} and order_id % 80 = 0, struct(3 n, 'failed' s), null)))"
    each = orders.selectExpr("*", f"explode({kinds}) kind")
    return each.selectExpr("order_id * 10 + kind.n payment_id", "order_id", f"{method} payment_method", "total_amount amount", "kind.s payment_status", "order_ts paid_at", "updated_at")


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """All versions of a source table under its contract."""
    if table == "payments":
        df = payments(source(spark, sf_dir, "orders"))
    elif table == "product_categories":
        df = _declared(spark, sf_dir, "part").select("p_type").distinct().selectExpr(
            "element_at(map('ECONOMY', 1L, 'LARGE', 2L, 'MEDIUM', 3L, 'PROMO', 4L, 'SMALL', 5L, 'STANDARD', 6L), p_type) category_id", "p_type category_name"
        ).selectExpr("category_id", "category_name", "element_at(array('beverage', 'food', 'merchandise'), cast(category_id % 3 as int) + 1) category_group")
    else:
        df = _versions(spark, sf_dir, table)
    contract = CONTRACTS[table]
    return df.select(*[df[n].cast(k).alias(n) for n, k in contract.fields.items()])


def bronze(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Versions with their ingestion date, and replay copies of those written late in their business day.

    Tables that are extracted whole have come twice.
    """
    df = source(spark, sf_dir, table)
    if CONTRACTS[table].cursor is None:
        return df.selectExpr("*", "explode(array(date'1994-12-01', date'1994-12-02')) as _ingestion_date")
    local = f"(updated_at + make_dt_interval(0, {ZONE_HOURS}))"
    day = f"cast({local} as date)"
    late = f"{local} >= cast(date_add({day}, 1) as timestamp_ntz) - make_dt_interval(0, 0, {LATE_MINUTES})"
    return df.selectExpr("*", f"explode(if({late}, array({day}, date_add({day}, 1)), array({day}))) as _ingestion_date")

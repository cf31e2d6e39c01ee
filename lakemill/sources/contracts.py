"""Source contracts: columns, keys, cursors, accepted values and references of the ten source tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METADATA = ("_extract_batch_id", "_extract_mode", "_extracted_at", "_source_file", "_ingestion_date")


@dataclass(frozen=True)
class Contract:
    """``columns`` as a Spark DDL string; ``cursor`` is None for tables that are extracted whole."""

    name: str
    columns: str
    key: str
    cursor: str | None = "updated_at"

    @property
    def fields(self) -> dict[str, str]:
        return {c.split(" ")[0]: c.split(" ")[1] for c in self.columns.split(", ")}


MONEY = "decimal(12,2)"
CONTRACTS = {
    c.name: c
    for c in (
        Contract("regions", "region_id bigint, region_name string", "region_id", None),
        Contract("areas", "area_id bigint, region_id bigint, area_name string", "area_id", None),
        Contract("product_categories", "category_id bigint, category_name string, category_group string", "category_id", None),
        Contract("stores", "store_id bigint, area_id bigint, store_code string, store_name string, store_type string, city string, opened_date date, closed_date date, status string, updated_at timestamp_ntz", "store_id"),
        Contract("products", f"product_id bigint, category_id bigint, sku string, product_name string, base_price {MONEY}, unit_cost {MONEY}, is_active boolean, launched_date date, updated_at timestamp_ntz", "product_id"),
        Contract("customers", "customer_id bigint, full_name string, city string, signup_date date, loyalty_tier string, updated_at timestamp_ntz", "customer_id"),
        Contract("promotions", f"promotion_id bigint, promo_code string, promo_name string, promo_type string, discount_value {MONEY}, start_date date, end_date date, updated_at timestamp_ntz", "promotion_id"),
        Contract("orders", f"order_id bigint, store_id bigint, customer_id bigint, promotion_id bigint, order_ts timestamp_ntz, order_channel string, order_status string, subtotal {MONEY}, discount_amount {MONEY}, tax_amount {MONEY}, total_amount {MONEY}, updated_at timestamp_ntz", "order_id"),
        Contract("order_items", f"order_item_id bigint, order_id bigint, product_id bigint, supplier_id bigint, quantity bigint, unit_price {MONEY}, line_discount {MONEY}, line_total {MONEY}, updated_at timestamp_ntz", "order_item_id"),
        Contract("payments", f"payment_id bigint, order_id bigint, payment_method string, amount {MONEY}, payment_status string, paid_at timestamp_ntz, updated_at timestamp_ntz", "payment_id"),
    )
}

#: What the enumerated columns may hold.
ACCEPTED = {
    ("stores", "store_type"): ("mall", "street", "office", "drive_thru", "kiosk"),
    ("stores", "status"): ("active", "temporarily_closed", "closed"),
    ("product_categories", "category_group"): ("beverage", "food", "merchandise"),
    ("customers", "loyalty_tier"): ("basic", "silver", "gold", "platinum"),
    ("promotions", "promo_type"): ("percent", "fixed", "bundle"),
    ("orders", "order_channel"): ("dine_in", "takeaway", "delivery"),
    ("orders", "order_status"): ("completed", "cancelled", "refunded"),
    ("payments", "payment_method"): ("cash", "card", "e_wallet"),
    ("payments", "payment_status"): ("paid", "failed", "refunded"),
}

#: (child, column, parent, key): every value of the column that is not null stands in the parent.
REFERENCES = (
    ("areas", "region_id", "regions", "region_id"),
    ("stores", "area_id", "areas", "area_id"),
    ("products", "category_id", "product_categories", "category_id"),
    ("orders", "store_id", "stores", "store_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("orders", "promotion_id", "promotions", "promotion_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("payments", "order_id", "orders", "order_id"),
)


def row_rules(table: str) -> dict[str, Column]:
    """Rules of one row, by name: true where the row is right; a null passes as a check constraint lets it."""
    c = F.col
    rules = {f"{column}_accepted": c(column).isin(*values) for (t, column), values in ACCEPTED.items() if t == table}
    filled = lambda *names: {f"{n}_filled": F.trim(n) != "" for n in names}
    rules |= {
        "regions": filled("region_name"),
        "areas": filled("area_name"),
        "product_categories": filled("category_name"),
        "stores": filled("store_code") | {"closed_has_date": (c("status") == "closed") == c("closed_date").isNotNull(), "closed_after_opened": c("closed_date") >= c("opened_date"), "name_not_blank": F.trim("store_name") != ""},
        "products": filled("product_name") | {"price_not_negative": c("base_price") >= 0, "cost_not_negative": c("unit_cost") >= 0, "sku_not_blank": F.trim("sku") != ""},
        "customers": {"name_not_blank": F.trim("full_name") != ""},
        "promotions": filled("promo_code", "promo_name") | {"discount_positive": c("discount_value") > 0, "ends_after_start": c("end_date") >= c("start_date"), "percent_at_most_100": (c("promo_type") != "percent") | (c("discount_value") <= 100)},
        "orders": {f"{n}_not_negative": c(n) >= 0 for n in ("subtotal", "discount_amount", "tax_amount")} | {"discount_within_subtotal": c("discount_amount") <= c("subtotal"), "total_not_negative": c("total_amount") >= 0},
        "order_items": {"quantity_positive": c("quantity") > 0, "line_not_negative": c("line_total") >= 0, "price_not_negative": c("unit_price") >= 0, "discount_not_negative": c("line_discount") >= 0, "discount_within_gross": c("line_discount") <= c("quantity").cast("int") * c("unit_price")},
        "payments": {"amount_positive": c("amount") > 0},
    }.get(table, {})
    return {name: F.coalesce(rule, F.lit(True)) for name, rule in rules.items()}


def drift(df: DataFrame, contract: Contract) -> list[str]:
    """All differences between a frame's columns and its contract; integers may widen."""
    found, wanted = {f.name: f.dataType.simpleString() for f in df.schema.fields}, contract.fields
    wide = ("smallint", "int", "bigint")
    wrong = [f"{n}: {found[n]} instead of {k}" for n, k in wanted.items() if n in found and found[n] != k and not (k == "bigint" and found[n] in wide)]
    return [f"missing {n}" for n in wanted if n not in found] + [f"unexpected {n}" for n in found if n not in wanted] + wrong


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns in order and in type, or one error that names every difference."""
    if problems := drift(df, contract):
        raise ValueError(f"{contract.name}: " + "; ".join(problems))
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in contract.fields.items()])

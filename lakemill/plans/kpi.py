"""KPI queries over the marts: optional filters, a grain, ratio-of-sums measures, order and limit.

A question is a small record. The same record gives the Spark query and the text of its DuckDB counterpart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions.columns import ratio
from lakemill.plans.counterpart import over_warehouse
from lakemill.plans.warehouse import warehouse


def distinct(column: str) -> Column:
    """Distinct values. A store-day's key stands in one row of its mart (`dq02_more_unique`), so its rows are counted and no key is moved."""
    return F.count(F.lit(1)) if column == "store_day_key" else F.countDistinct(column)


@dataclass(frozen=True)
class Measure:
    """``kind``: sum, count, avg, min, max, distinct, or ratio of two sums (``over`` may be a distinct count)."""

    name: str
    kind: str
    column: str = ""
    over: str = ""

    def spark(self) -> Column:
        c = self.column
        if self.kind == "ratio":
            under = distinct(self.over[9:]) if self.over.startswith("distinct ") else F.sum(self.over)
            return ratio(F.sum(c), under).alias(self.name)
        made = {"sum": F.sum, "avg": lambda x: ratio(F.sum(x), F.count(x)), "min": F.min, "max": F.max, "distinct": distinct, "count": lambda _: F.count(F.lit(1))}[self.kind](c)
        kind = {"sum": "double", "count": "bigint", "distinct": "bigint"}.get(self.kind)
        return (made.cast(kind) if kind else made).alias(self.name)

    def sql(self) -> str:
        c = self.column
        if self.kind == "ratio":
            under = f"count(DISTINCT {self.over[9:]})" if self.over.startswith("distinct ") else f"sum({self.over})"
            return f"sum({c})::DOUBLE / nullif({under}::DOUBLE, 0) AS {self.name}"
        made = {"sum": f"sum({c})::DOUBLE", "avg": f"sum({c})::DOUBLE / nullif(count({c}), 0)", "min": f"min({c})", "max": f"max({c})", "distinct": f"count(DISTINCT {c})::BIGINT", "count": "count(*)::BIGINT"}[self.kind]
        return f"{made} AS {self.name}"


@dataclass(frozen=True)
class Question:
    mart: str
    measures: tuple[Measure, ...]
    grain: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    order: str = ""
    descending: bool = True
    limit: int = 0
    #: Columns of the grain that are shown under a label, with its kind: ``bare`` or ``title``.
    labels: tuple[tuple[str, str], ...] = ()


#: What stands before the number in a store's name.
PREFIX = "^Supplier#0*"


def label(column: str, kind: str) -> Column:
    """A name without its prefix, or a code as words that begin with capitals."""
    return F.regexp_replace(column, PREFIX, "") if kind == "bare" else F.initcap(F.replace(F.col(column), F.lit("_"), F.lit(" ")))


def label_sql(column: str, kind: str) -> str:
    if kind == "bare":
        return f"regexp_replace({column}, '{PREFIX}', '')"
    return f"array_to_string(list_transform(string_split(replace({column}, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"


def kpi_query(mart: DataFrame, question: Question) -> DataFrame:
    """Each filter is a set of values or, for a pair named by ``range``, two bounds; one that is None asks nothing."""
    df = mart
    for column, wanted in question.filters.items():
        if wanted is not None:
            df = df.filter(F.col(column).between(*wanted[1:]) if wanted[0] == "range" else F.col(column).isin(*wanted))
    columns = [m.spark() for m in question.measures]
    df = df.groupBy(*question.grain).agg(*columns) if question.grain else df.agg(*columns)
    if question.order:
        by = F.desc_nulls_last(question.order) if question.descending else F.asc_nulls_last(question.order)
        df = df.orderBy(by, *[F.asc_nulls_last(g) for g in question.grain])
    df = df.limit(question.limit) if question.limit else df
    return df.withColumns({column: label(column, kind) for column, kind in question.labels}) if question.labels else df


def kpi_sql(question: Question) -> str:
    text = lambda v: f"'{v}'"
    where = []
    for column, wanted in question.filters.items():
        if wanted is not None:
            where.append(f"{column} BETWEEN {text(wanted[1])} AND {text(wanted[2])}" if wanted[0] == "range" else f"{column} IN ({', '.join(map(text, wanted))})")
    parts = [f"SELECT {', '.join([*question.grain, *(m.sql() for m in question.measures)])} FROM {question.mart}"]
    parts += [f"WHERE {' AND '.join(where)}"] if where else []
    parts += [f"GROUP BY {', '.join(question.grain)}"] if question.grain else []
    if question.limit:
        parts.append(f"ORDER BY {question.order} {'DESC' if question.descending else 'ASC'} NULLS LAST, {', '.join(f'{g} NULLS LAST' for g in question.grain)} LIMIT {question.limit}")
    if question.labels:
        shown = ", ".join(f"{label_sql(column, kind)} AS {column}" for column, kind in question.labels)
        parts = [f"SELECT * REPLACE ({shown}) FROM (", *parts, ")"]
    return over_warehouse(" ".join(parts))


def total(name: str, column: str) -> Measure:
    return Measure(name, "sum", column)


def per(name: str, column: str, over: str) -> Measure:
    return Measure(name, "ratio", column, over)


SD = "distinct store_day_key"
E_SALES, E_TX = total("sales", "total_sales"), total("transactions", "transaction_count")
E_AOV, E_ADS, E_ADQ = per("aov", "total_sales", "transaction_count"), per("ads", "total_sales", "store_days"), per("adq", "product_quantity", "store_days")
MARGIN = per("margin_rate", "gross_margin", "item_sales")
S_ADS, S_ADQ = per("ads", "total_sales", SD), per("adq", "product_quantity", SD)
P_SALES, P_UNITS = total("sales", "product_sales"), total("units", "quantity_sold")
P_MARGIN = per("margin_rate", "gross_margin", "product_sales")
CUSTOMERS, MONETARY = Measure("customers", "count"), total("monetary", "monetary")
R_AVG = (Measure("avg_monetary", "avg", "monetary"), Measure("avg_frequency", "avg", "frequency"))
E, S, P, R, C = "executive_daily", "store_performance", "product_performance", "customer_rfm", "customer_cohorts"

QUESTIONS = {
    "bi01_sales": Question(E, (E_SALES,)),
    "bi02_transactions": Question(E, (E_TX,)),
    "bi03_aov": Question(E, (E_AOV,)),
    "bi04_ads": Question(E, (E_ADS,)),
    "bi05_adq": Question(E, (E_ADQ,)),
    "bi06_margin": Question(E, (MARGIN,)),
    "bi07_sales_by_day": Question(E, (E_SALES,), ("business_date",), order="business_date", descending=False),
    "bi08_transactions_by_day": Question(E, (E_TX,), ("business_date",), order="business_date", descending=False),
    "bi09_ads_by_day": Question(E, (E_ADS,), ("business_date",), order="business_date", descending=False),
    "bi10_adq_by_day": Question(E, (E_ADQ,), ("business_date",), order="business_date", descending=False),
    "bi11_margin_by_day": Question(E, (MARGIN,), ("business_date",), order="business_date", descending=False),
    "bi12_sales_by_day_name": Question(E, (E_SALES, Measure("day_number", "min", "day_of_week_number")), ("day_name",), order="day_number", descending=False),
    "bi13_store_sales": Question(S, (E_SALES,)),
    "bi14_store_transactions": Question(S, (E_TX,)),
    "bi15_store_aov": Question(S, (E_AOV,)),
    "bi16_store_ads": Question(S, (S_ADS,)),
    "bi17_store_adq": Question(S, (S_ADQ,)),
    "bi18_store_margin": Question(S, (MARGIN,)),
    "bi19_region_sales": Question(S, (E_SALES,), ("region_name",), order="sales"),
    "bi20_region_ads": Question(S, (S_ADS,), ("region_name",), order="ads"),
    "bi21_top_stores": Question(S, (E_SALES,), ("store_name",), order="sales", limit=10, labels=(("store_name", "bare"),)),
    "bi22_bottom_stores": Question(S, (S_ADS,), ("store_name",), order="ads", descending=False, limit=10, labels=(("store_name", "bare"),)),
    "bi23_store_type_ads": Question(S, (S_ADS,), ("store_type",), order="ads", labels=(("store_type", "title"),)),
    "bi24_region_margin": Question(S, (MARGIN,), ("region_name",), order="margin_rate"),
    "bi26_store_table": Question(S, (E_SALES, E_TX, E_AOV, S_ADS, S_ADQ, MARGIN), ("store_name", "region_name", "area_name", "store_type"), order="sales"),
    "bi27_units": Question(P, (P_UNITS,)),
    "bi28_product_sales": Question(P, (P_SALES,)),
    "bi29_product_margin": Question(P, (P_MARGIN,)),
    "bi30_asp": Question(P, (per("asp", "product_sales", "quantity_sold"),)),
    "bi31_top_products_sales": Question(P, (P_SALES,), ("product_name",), order="sales", limit=10),
    "bi32_top_products_units": Question(P, (P_UNITS,), ("product_name",), order="units", limit=10),
    "bi33_category_sales": Question(P, (P_SALES,), ("category_name",), order="sales"),
    "bi34_category_margin": Question(P, (P_MARGIN,), ("category_name",), order="margin_rate"),
    "bi35_customers": Question(R, (CUSTOMERS,)),
    "bi36_customer_sales": Question(R, (MONETARY,)),
    "bi37_avg_spend": Question(R, R_AVG[:1]),
    "bi38_avg_orders": Question(R, R_AVG[1:]),
    "bi39_segment_customers": Question(R, (CUSTOMERS,), ("customer_segment",), order="customers"),
    "bi40_segment_sales": Question(R, (MONETARY,), ("customer_segment",), order="monetary"),
    "bi42_tiers": Question(R, (CUSTOMERS, MONETARY, *R_AVG), ("loyalty_tier",), order="monetary", labels=(("loyalty_tier", "title"),)),
    "rp1_totals": Question(E, (E_SALES, E_TX, E_AOV, E_ADS, E_ADQ, MARGIN, total("units", "product_quantity"), total("store_days", "store_days"), Measure("first_day", "min", "business_date"), Measure("last_day", "max", "business_date"), Measure("days", "count"))),
    "rp2_stores_regions": Question(S, (Measure("stores", "distinct", "store_id"), Measure("regions", "distinct", "region_name"))),
    "rp3_customers": Question(R, (CUSTOMERS, *R_AVG)),
    "rp4_daily": Question(E, (E_SALES, E_TX, E_ADS, E_ADQ), ("business_date",), order="business_date", descending=False),
    "rp5_regions": Question(S, (E_SALES, Measure("store_days", "distinct", "store_day_key"), S_ADS, S_ADQ), ("region_name",), order="sales"),
    "rp6_region_days": Question(S, (S_ADS,), ("business_date", "region_name")),
    "rp7_top_stores": Question(S, (E_SALES, S_ADS), ("store_name", "region_name", "store_type"), order="sales", limit=10),
    "rp8_types": Question(S, (Measure("stores", "distinct", "store_id"), S_ADS), ("store_type",)),
    "rp9_categories": Question(P, (P_SALES, P_UNITS, P_MARGIN), ("category_name",), order="sales"),
    "rp10_segments": Question(R, (CUSTOMERS, MONETARY), ("customer_segment",), order="customers"),
    "in2_segments": Question(R, (CUSTOMERS, Measure("avg_recency", "avg", "recency_days"), *R_AVG, MONETARY), ("customer_segment",)),
    "flt5_filtered_stores": Question(S, (E_SALES, S_ADS, MARGIN), ("store_type",), {"business_date": ("range", "1997-01-01", "1998-12-31"), "store_type": ("mall", "kiosk"), "area_name": None}),
    "flt5_filtered_products": Question(P, (P_SALES, P_UNITS), ("category_name",), {"category_group": ("food", "beverage"), "business_date": ("range", "1996-01-01", "1996-12-31")}),
    "flt5_filtered_customers": Question(R, (CUSTOMERS, MONETARY), ("customer_segment",), {"loyalty_tier": ("gold", "platinum")}),
    "flt5_filtered_regions": Question(S, (E_SALES, S_ADS), ("region_name", "area_name"), {"region_name": ("ASIA", "EUROPE"), "area_name": ("CHINA", "FRANCE", "GERMANY", "JAPAN", "NATION_1", "NATION_2", "NATION_7")}),
    "flt5_filtered_store_names": Question(S, (E_SALES, S_ADS), ("store_name",), {"store_name": tuple(f"Supplier#{i:09d}" for i in range(1, 6))}),
    "flt5_filtered_product_ids": Question(P, (P_SALES, P_UNITS), ("product_name",), {"product_id": ("1", "2", "3", "5", "8")}),
    "flt5_filtered_segments": Question(R, (CUSTOMERS, MONETARY), ("loyalty_tier",), {"customer_segment": ("Champions", "At Risk")}),
    "flt5_filtered_cohorts": Question(C, (Measure("cells", "count"), total("sales", "total_sales")), ("cohort_month",), {"cohort_month": ("range", "1995-01-01", "1996-06-30")}),
    "daily_sales": Question("daily_orders", (E_SALES, E_TX, E_AOV), ("business_date",), order="business_date", descending=False),
}


def _asked(question: Question):
    return lambda spark, sf_dir: kpi_query(warehouse(spark, sf_dir).mart(question.mart), question)


def queries() -> dict:
    return {name: _asked(q) for name, q in QUESTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: kpi_sql(q) for name, q in QUESTIONS.items()}

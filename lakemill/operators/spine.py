"""Calendars: date and time dimensions and the store-day spine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.sources.adapters import ZONE_HOURS


def date_bounds(fact: DataFrame, date: str) -> DataFrame:
    """One row: the first and the last day."""
    return fact.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def dim_date(fact: DataFrame, date: str = "business_date") -> DataFrame:
    """A row for each day between the fact's bounds, without gaps."""
    days = date_bounds(fact, date).filter("min_date is not null").select(F.explode(F.sequence("min_date", "max_date")).alias("calendar_date"))
    d = F.col("calendar_date")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.extract(F.lit("YEAROFWEEK"), d).alias("iso_year"),
        F.weekofyear(d).alias("iso_week"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofweek(d).alias("day_of_week_number"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.trunc(d, "week").alias("week_start_date"),
        F.trunc(d, "month").alias("month_start_date"),
        F.trunc(d, "quarter").alias("quarter_start_date"),
        F.trunc(d, "year").alias("year_start_date"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )


def daypart(hour) -> F.Column:
    return F.when(hour.between(5, 10), "Morning").when(hour.between(11, 13), "Lunch").when(hour.between(14, 16), "Afternoon").when(hour.between(17, 20), "Evening").otherwise("Late Night")


def dim_time(spark: SparkSession) -> DataFrame:
    """A row for each minute of the day."""
    hour, minute = F.expr("id div 60"), F.expr("id % 60")
    label = F.format_string("%02d:%02d", hour, minute)
    return spark.range(1440).select(
        F.col("id").alias("time_key"), hour.alias("hour_24"), minute.alias("minute"), F.concat(label, F.lit(":00")).alias("time_value"), label.alias("time_label"), daypart(hour).alias("daypart")
    )


_SHIFT = f"make_dt_interval(0, {ZONE_HOURS})"
#: The first and the last local midnight inside a store's version, cut to the store's opening; the last is null where nothing ends it.
FIRST = f"greatest(opened_date, cast(valid_from + {_SHIFT} + make_dt_interval(1) - make_dt_interval(0, 0, 0, 0.000001) as date))"
LAST = f"least(closed_date, cast(valid_to + {_SHIFT} - make_dt_interval(0, 0, 0, 0.000001) as date))"


def store_spans(fact: DataFrame, dim_store: DataFrame, exclude_status: tuple[str, ...] = ()) -> DataFrame:
    """(store_id, store_sk, low, high): the days of each store version that has any, cut to the fact's bounds."""
    trading = dim_store.filter(~F.col("status").isin(*exclude_status)) if exclude_status else dim_store
    dated = trading.join(F.broadcast(date_bounds(fact, "business_date")))
    return dated.selectExpr("store_id", "store_sk", f"greatest(min_date, {FIRST}) as low", f"least(max_date, {LAST}) as high").filter("low <= high")


def store_calendar(fact: DataFrame, dim_store: DataFrame, exclude_status: tuple[str, ...] = ()) -> DataFrame:
    """A row for each store and day on which it was open, with the version valid at local midnight.

    Each version gives the days from the first to the last midnight inside it, cut to the fact's bounds and
    the store's opening; the days are made by a sequence, so no calendar is joined.
    """
    days = F.explode(F.sequence("low", "high")).alias("business_date")
    return store_spans(fact, dim_store, exclude_status).select("store_id", "store_sk", days).withColumn("store_day_key", F.concat_ws("-", "store_id", "business_date"))


def open_days(spans: DataFrame, count: str) -> DataFrame:
    """(business_date, ``count``): on how many spans each day lies, without making the days of a span: they begin and end by sums
    over the days on which any begins or ends, a row each."""
    ends = F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("n")), F.struct(F.date_add("high", 1).alias("at"), F.lit(-1).alias("n")))
    changes = spans.select(F.explode(ends).alias("e")).groupBy("e.at").agg(F.sum("e.n").alias("n"))
    order = Window.orderBy("at")
    runs = changes.select("at", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(count), F.lead("at").over(order).alias("next"))
    return runs.filter(F.col(count) > 0).select(F.explode(F.sequence("at", F.date_sub("next", 1))).alias("business_date"), count)


def with_sold_days(spans: DataFrame, sold: DataFrame, by: list[str]) -> DataFrame:
    """Spans with ``sold``, the rows of their days with sales as an array: store-days without a row for each day that has none."""
    day = F.struct("business_date", *[c for c in sold.columns if c not in (*by, "business_date")])
    return spans.join(sold.groupBy(*by).agg(F.collect_list(day).alias("sold")), by, "left")


def each_store_day(spans: DataFrame) -> DataFrame:
    """A row for each day of what ``with_sold_days`` gave, zeros on days without sales; nothing is moved."""
    keys = [c for c in spans.columns if c not in ("low", "high", "sold")]
    sold = spans.select(*keys, F.inline("sold"))
    others = F.array_except(F.sequence("low", "high"), F.coalesce(F.col("sold.business_date"), F.array().cast("array<date>")))
    quiet = spans.select(*keys, F.explode(others).alias("business_date"))
    zeros = [F.lit(0).cast(f.dataType).alias(f.name) for f in sold.schema.fields if f.name not in quiet.columns]
    return sold.unionByName(quiet.select("*", *zeros)).withColumn("store_day_key", F.concat_ws("-", "store_id", "business_date"))


def repeated_store_days(spans: DataFrame) -> DataFrame:
    """(n): how many stores' days stand more than once among the rows of ``each_store_day``, looked at store by store, so that no row of a day is moved."""
    sold = F.coalesce(F.col("sold.business_date"), F.array().cast("array<date>")).alias("sold")
    every = F.flatten(F.transform("spans", lambda s: F.concat(s["sold"], F.array_except(F.sequence(s["low"], s["high"]), s["sold"]))))
    days = spans.filter("store_id is not null").groupBy("store_id").agg(F.collect_list(F.struct("low", "high", sold)).alias("spans")).select(F.array_sort(every).alias("days"))
    again = F.array_distinct(F.filter("days", lambda d, i: (i > 0) & (d == F.get("days", i - 1))))
    one = F.size("days") == F.size(F.array_distinct("days"))
    return days.agg(F.coalesce(F.sum(F.when(one, 0).otherwise(F.size(again))), F.lit(0)).cast("long").alias("n"))

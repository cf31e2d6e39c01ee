"""Versions and history: deduplication, latest state, slowly changing dimensions, point-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INGESTED = ("_ingestion_date", "_loaded_at", "_extracted_at", "_extract_batch_id")


def _top(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__row", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__row = 1").drop("__row")


def dedup_versions(df: DataFrame, pk: str, cursor: str | None, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """One row for each version (key and cursor): the newest ingestion wins, then the further columns, descending."""
    by = [pk] if cursor is None else [pk, cursor]
    order = [c for c in INGESTED if c in df.columns] + list(tiebreak)
    return _top(df, by, [F.desc_nulls_last(c) for c in order])


def latest_state(df: DataFrame, pk: str, cursor: str, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """The newest version of each key."""
    order = [cursor, *(c for c in INGESTED if c in df.columns), *tiebreak]
    return _top(df, [pk], [F.desc_nulls_last(c) for c in order])


def scd2(df: DataFrame, pk: str, cursor: str) -> DataFrame:
    """Versions as intervals [valid_from, valid_to); the last one of a key is open and current."""
    following = F.lead(cursor).over(Window.partitionBy(pk).orderBy(cursor))
    return df.withColumn("valid_to", following).withColumnRenamed(cursor, "valid_from").withColumn("is_current", F.col("valid_to").isNull())


def merge_scd2(intervals: DataFrame, arrived: DataFrame, pk: str, cursor: str) -> DataFrame:
    """The intervals of the keys that ``arrived`` touches, anew: late versions split an interval, new ones close the open one.

    ``intervals`` is what ``scd2`` or an earlier merge gave, with ``valid_from`` for the cursor; ``arrived`` are versions in any
    order, repeats among them. Keys that have no new version are not in the result: theirs stay as they are. Whatever the
    order of arrival, the merges end where ``scd2`` over the deduplicated versions does.
    """
    touched = arrived.select(F.col(pk).alias("__pk")).distinct()
    held = intervals.join(touched, F.col(pk) == F.col("__pk"), "left_semi").drop("valid_to", "is_current").withColumnRenamed("valid_from", cursor)
    return scd2(dedup_versions(held.unionByName(arrived), pk, cursor), pk, cursor)


def pit_join(fact: DataFrame, versions: DataFrame, fact_key: str, version_key: str, ts: str) -> DataFrame:
    """Left join of each fact to the version of its key that was valid at ``ts``: an equi join with a residual.

    ``versions`` must share no other column name with ``fact``; its key is dropped.
    """
    v = versions.withColumnRenamed(version_key, "__version_key")
    valid = (F.col(ts) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
    return fact.join(v, (F.col(fact_key) == F.col("__version_key")) & valid, "left").drop("__version_key")


def pit_join_union(fact: DataFrame, versions: DataFrame, fact_key: str, version_key: str, ts: str, carry: list[str]) -> DataFrame:
    """The same join for keys with very many versions: one pass over both in time order, versions before facts of the same instant.

    A key is cut by months, so that none has all its facts in one task; a version stands in each month that it
    reaches into, up to the last fact.
    """
    kept = F.struct(*[F.col(c) for c in carry], F.col("valid_to")).alias("__version")
    month = lambda at: F.trunc(F.col(at).cast("date") if isinstance(at, str) else at.cast("date"), "month")
    last = fact.agg(F.max(ts).alias("__last"))
    spans = versions.join(F.broadcast(last)).withColumn("__until", F.least("valid_to", "__last")).filter("valid_from <= __until")
    spans = spans.withColumn("__month", F.explode(F.sequence(month("valid_from"), month("__until"), F.expr("interval 1 month"))))
    v = spans.select(F.col(version_key).alias("__key"), "__month", F.col("valid_from").alias("__ts"), F.lit(0).alias("__kind"), kept, F.lit(None).cast(fact.select(F.struct("*")).schema[0].dataType).alias("__fact"))
    f = fact.select(F.col(fact_key).alias("__key"), month(ts).alias("__month"), F.col(ts).alias("__ts"), F.lit(1).alias("__kind"), F.lit(None).cast(v.schema["__version"].dataType).alias("__version"), F.struct("*").alias("__fact"))
    order = Window.partitionBy("__key", "__month").orderBy("__ts", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = v.unionByName(f).withColumn("__seen", F.last("__version", ignorenulls=True).over(order)).filter("__kind = 1")
    valid = F.col("__key").isNotNull() & (F.col("__seen.valid_to").isNull() | (F.col("__ts") < F.col("__seen.valid_to")))
    return seen.select("__fact.*", *[F.when(valid, F.col(f"__seen.{c}")).alias(c) for c in carry])


def interval_overlaps(versions: DataFrame, key: str) -> DataFrame:
    """Versions that begin before an earlier version of the same key has ended: one window, no self join."""
    ends = F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp_ntz"))).over(Window.partitionBy(key).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1))
    return versions.withColumn("__end", ends).filter(F.col("valid_from") < F.col("__end")).drop("__end")


def snapshot_changes(before: DataFrame, after: DataFrame, pk: str, cursor: str, now: Column) -> DataFrame:
    """Rows of ``after`` that are new or really changed, with a new cursor unless the writer set one; plain repeats give none."""
    values = [c for c in after.columns if c not in (pk, cursor)]
    old = before.select(F.col(pk).alias("__pk"), F.struct(*values).alias("__old"), F.col(cursor).alias("__cursor"))
    joined = after.join(old, F.col(pk) == F.col("__pk"), "left")
    changed = F.col("__pk").isNull() | ~F.struct(*values).eqNullSafe(F.col("__old"))
    stamp = F.when(F.col("__pk").isNull() | ~F.col(cursor).eqNullSafe(F.col("__cursor")), F.col(cursor)).otherwise(now)
    return joined.filter(changed).withColumn(cursor, stamp).select(*after.columns)

"""Distinct counts that can be merged: exact bitmaps of whole numbers, kept at a fine grain and united at question time.

A bitmap holds 32,768 neighbouring numbers, so a set is a few rows (bucket, bits) of 4 KB. Bitmaps of different groups are united
by a bitwise or, which an aggregate does before the shuffle; counts are exact at every grain and under every filter of the
grain's columns, and the rows that were counted are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, by: list[str], ids: dict[str, Column]) -> DataFrame:
    """(by..., kind, bucket, bits): for each group and kind the set of its ids; nulls are in no set."""
    each = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.cast("long").alias("id"))) for kind, c in ids.items()]))
    rows = df.select(*by, F.explode(each).alias("e")).select(*by, "e.kind", F.bitmap_bucket_number("e.id").alias("bucket"), F.bitmap_bit_position("e.id").alias("at"))
    return rows.groupBy(*by, "kind", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def listed(df: DataFrame, by: list[str], ids: dict[str, Column]) -> DataFrame:
    """(by..., kind, bucket, places): the same sets as sorted places in their bucket, for groups of which most hold few of its numbers."""
    each = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.cast("long").alias("id"))) for kind, c in ids.items()]))
    rows = df.select(*by, F.explode(each).alias("e")).select(*by, "e.kind", F.bitmap_bucket_number("e.id").alias("bucket"), F.bitmap_bit_position("e.id").cast("smallint").alias("at"))
    return rows.groupBy(*by, "kind", "bucket").agg(F.array_sort(F.collect_set("at")).alias("places"))


def drawn(lists: DataFrame, by: list[str]) -> DataFrame:
    """Bitmaps of coarser groups from what ``listed`` gave."""
    places = lists.select(*by, "kind", "bucket", F.explode("places").alias("at"))
    return places.groupBy(*by, "kind", "bucket").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))


def united(sets: DataFrame, by: list[str]) -> DataFrame:
    """The sets of coarser groups."""
    return sets.groupBy(*by, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(sets: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """(by..., and a column for each kind): distinct ids of coarser groups."""
    sizes = united(sets.filter(F.col("kind").isin(*kinds)), by).select(*by, "kind", F.bitmap_count("bits").alias("n"))
    return sizes.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])

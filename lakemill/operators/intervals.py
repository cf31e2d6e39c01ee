"""Containment of days in spans of days, without a row for each day of a span or a range join.

A span of days is the union of few aligned blocks of 2**k days, two a size at most; a day lies in one block of each
size. So a day lies in a span exactly if one of its blocks is one of the span's: an equi join on blocks, with about
twenty rows a day and forty a span at most, whatever their lengths. What is kept of the spans can be aggregated
by block before the join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sizes are 2**0 to 2**(SIZES - 1) days; days are counted from SHIFT days before 1970.
SIZES, SHIFT = 22, 1 << 20


def day_number(day: Column) -> Column:
    return (F.datediff(day, F.lit("1970-01-01").cast("date")) + SHIFT).cast("long")


def _block(size: Column, number: Column) -> Column:
    return size.cast("long") * F.lit(1 << 32) + number


def blocks_of_day(day: Column) -> Column:
    """The blocks that a day lies in, one of each size."""
    number = day_number(day)
    return F.transform(F.sequence(F.lit(0), F.lit(SIZES - 1)), lambda k: _block(k, F.floor(number / F.pow(F.lit(2), k)).cast("long")))


def blocks_of_span(first: Column, past: Column) -> Column:
    """The fewest blocks that make up the days from ``first`` up to but not including ``past``; none for an empty or unknown span."""
    none = F.array().cast("array<bigint>")
    odd = lambda x: F.pmod(x, F.lit(2)) == 1

    def step(held: Column, size: Column) -> Column:
        low, high = held["low"], held["high"]
        left = (low < high) & odd(low)
        low_past = low + F.when(left, 1).otherwise(0)
        right = (low_past < high) & odd(high)
        high_past = high - F.when(right, 1).otherwise(0)
        taken = F.concat(held["blocks"], F.when(left, F.array(_block(size, low))).otherwise(none), F.when(right, F.array(_block(size, high - 1))).otherwise(none))
        half = lambda x: F.floor(x / F.lit(2)).cast("long")
        return F.struct(half(low_past).alias("low"), half(high_past).alias("high"), taken.alias("blocks"))

    start = F.struct(day_number(first).alias("low"), day_number(past).alias("high"), none.alias("blocks"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(SIZES - 1)), start, step, lambda held: held["blocks"])
    return F.when(first < past, found).otherwise(none)

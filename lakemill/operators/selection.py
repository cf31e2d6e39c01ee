"""Tiles of a whole table by selecting their bounds, without sorting or moving rows.

The last row of each tile has a known rank. A round counts, in one pass, the rows of each interval in which such a row must
stand, in at most BINS parts of it, and keeps the part that holds the rank; a range of 64 bits is down to one value
after seven rounds at most, usually two. Where rows of that value fall into two tiles, the same rounds over their keys
find the last key. Then a row's tile is the number of bounds that it lies beyond: a comparison with literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


@dataclass
class Bound:
    """The row of rank ``rank`` (from 1) by ``measure``: in [low, high], with ``before`` rows under low. ``value`` is set when keys are searched."""

    measure: str
    rank: int
    low: int
    high: int
    before: int = 0
    value: int | None = None

    @property
    def shift(self) -> int:
        shift = 0
        while (self.high >> shift) - (self.low >> shift) >= BINS:
            shift += 1
        return shift

    @property
    def place(self) -> tuple:
        return self.measure, self.value, self.low, self.high


def _counted(df: DataFrame, measures: dict[str, Column], key: Column, bounds: list[Bound]) -> dict[tuple, list[tuple[int, int]]]:
    """Counts by part for each interval of ``bounds``: at most BINS rows for each reach the driver."""
    places = list(dict.fromkeys((b.place, b.shift) for b in bounds))
    parts = []
    for i, ((measure, value, low, high), shift) in enumerate(places):
        column = key if value is not None else measures[measure]
        inside = (column >= low) & (column <= high) if value is None else (measures[measure] == value) & (column >= low) & (column <= high)
        parts.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.shiftright(column, shift).alias("part"))))
    rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).groupBy("p.i", "p.part").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[tuple, list[tuple[int, int]]] = {place: [] for place, _ in places}
    for r in rows:
        out[places[r["i"]][0]].append((r["part"], r["n"]))
    return {place: sorted(found) for place, found in out.items()}


def _narrowed(bound: Bound, counts: list[tuple[int, int]], keys: tuple[int, int]) -> Bound:
    """The part that holds the rank, or, with one value left, the keys of its rows."""
    before, shift = bound.before, bound.shift
    for part, n in counts:
        if before + n >= bound.rank:
            low, high = max(bound.low, part << shift), min(bound.high, ((part + 1) << shift) - 1)
            if low < high or bound.value is not None:
                return Bound(bound.measure, bound.rank, low, high, before, bound.value)
            last = before + n == bound.rank
            return Bound(bound.measure, bound.rank, keys[1] if last else keys[0], keys[1], before, low)
        before += n
    raise ArithmeticError("the frame changed between two passes")


def tile_bounds(df: DataFrame, tiles: int, key: str, measures: dict[str, Column]) -> dict[str, list[tuple[int, int]]]:
    """For each measure the (value, key) of the last row of each tile but the last, as ``ntile`` deals rows by value and key."""
    key_column, names = F.col(key).cast("long"), list(measures)
    stats = df.agg(F.count(F.lit(1)), F.min(key_column), F.max(key_column), *[f(measures[m]) for m in names for f in (F.min, F.max)]).first()
    n, keys, ranges = stats[0], (stats[1], stats[2]), {m: (stats[3 + 2 * i], stats[4 + 2 * i]) for i, m in enumerate(names)}
    short, more = divmod(n, tiles)
    ranks = [r for r in dict.fromkeys(short * t + min(t, more) for t in range(1, tiles)) if 0 < r < n]
    bounds = [Bound(m, r, *ranges[m]) for m in names for r in ranks]
    while todo := [b for b in bounds if b.value is None or b.low < b.high]:
        counts = _counted(df, measures, key_column, todo)
        bounds = [_narrowed(b, counts[b.place], keys) if b.place in counts else b for b in bounds]
    return {m: [(b.value, b.high) for b in bounds if b.measure == m] for m in names}


def tiles_by_selection(df: DataFrame, tiles: int, key: str, measures: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each measure: its ``ntile`` over the whole frame by the measure, from the smallest, and then by the key.

    Measures and key are whole numbers without nulls, keys differ; negate a measure for falling order. ``df`` is read once a
    round, so it should be a table or settled. Tiles beyond the number of rows stay empty, as with ``ntile``.
    """
    bounds = tile_bounds(df, tiles, key, measures)
    k = F.col(key).cast("long")
    beyond = lambda m, v, last: F.when((measures[m] > v) | ((measures[m] == v) & (k > last)), 1).otherwise(0)
    return df.withColumns({m: sum((beyond(m, *b) for b in bounds[m]), F.lit(1)).cast("long") for m in measures})


def cents(column: str) -> Column:
    """An amount with two decimals as a whole number."""
    return (F.col(column) * 100).cast("long")

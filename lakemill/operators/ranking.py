"""Shares and inversions without moving all rows to one task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions.lineage import settle
from lakemill.operators.selection import tile_bounds

#: Entities of which all pairs may be looked at.
MOST_RANKED = 2_000
#: Parts into which each measure is cut where pairs are only counted.
CUTS = 64


def share_of_total(df: DataFrame, measure: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Percentage of a measure in the total of its group; meant for aggregates."""
    total = F.sum(measure).over(Window.partitionBy(*(by or [])))
    return df.withColumn(out, F.try_divide(F.lit(100.0) * F.col(measure).cast("double"), total.cast("double")))


def rank_inversions(df: DataFrame, entity: str, first: str, second: str) -> DataFrame:
    """Pairs of entities that the two measures rank in opposite order; an aggregate of more than MOST_RANKED rows is refused."""
    if df.select(entity).limit(MOST_RANKED + 1).count() > MOST_RANKED:
        raise ValueError(f"more than {MOST_RANKED} entities to compare with each other")
    ranked = df.select(F.col(entity).alias("e"), F.rank().over(Window.orderBy(F.desc(first))).alias("r1"), F.rank().over(Window.orderBy(F.desc(second))).alias("r2"))
    a, b = ranked.alias("a"), ranked.alias("b")
    crossed = (F.col("a.r1") < F.col("b.r1")) & (F.col("a.r2") > F.col("b.r2"))
    return a.join(b, crossed).select(F.col("a.e").alias("higher"), F.col("b.e").alias("lower"))


def crossings(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each i the number of j with x[j] > x[i] and y[j] < y[i], by merging halves: n log n."""
    n = len(x)
    #: Of equal x the smaller y goes first, so that none counts the other.
    order = np.lexsort((y, x))
    level = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    count, place, width = np.zeros(n, np.int64), np.arange(n), 1
    while width < n:
        pair, right = place // (2 * width), place // width % 2 == 1
        keys = np.sort(pair[right] * (n + 1) + level[right])
        asked = ~right
        base = pair[asked] * (n + 1)
        count[asked] += np.searchsorted(keys, base + level[asked]) - np.searchsorted(keys, base)
        width *= 2
    out = np.empty(n, np.int64)
    out[order] = count
    return out


def _part(column: Column, cuts: list[int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(column > c, 1).otherwise(0) for c in cuts], F.lit(0)).cast("int")


def inversion_counts(df: DataFrame, entity: str, first: Column, second: Column, cuts: int = CUTS) -> DataFrame:
    """(entity, overtaken_by): for each entity how many that the first measure ranks lower the second ranks higher; entities are whole
    numbers that differ, measures whole numbers without nulls, ties count for nothing. No pair is formed.

    Both measures are cut at selected bounds into parts of about equal size, a value that fills more than one part being a part of
    its own. Entities in a lower part of the one and a higher part of the other count by a table of the parts' sizes, at most
    (2 * cuts)^2 numbers; those in the same part of a measure are counted within that part, one task each.
    """
    x, y = -F.col("__first"), -F.col("__second")
    rows = settle(df.select(F.col(entity).alias("entity"), first.cast("long").alias("__first"), second.cast("long").alias("__second")))
    bounds = tile_bounds(rows, cuts, "entity", {"x": x, "y": y})
    edges = {m: sorted({c for value, _ in found for c in (value - 1, value)}) for m, found in bounds.items()}
    rows = settle(rows.select("entity", x.alias("x"), y.alias("y"), _part(x, edges["x"]).alias("a"), _part(y, edges["y"]).alias("b")))
    sizes = np.zeros((len(edges["x"]) + 2, len(edges["y"]) + 2), np.int64)
    for r in rows.groupBy("a", "b").count().collect():
        sizes[r["a"], r["b"] + 1] = r["count"]
    #: beyond[a][b]: entities of a later part than a of x and an earlier one than b of y.
    beyond = np.vstack([np.cumsum(sizes[::-1], axis=0)[::-1][1:], np.zeros((1, sizes.shape[1]), np.int64)]).cumsum(axis=1)
    table = df.sparkSession.createDataFrame([(a, b, int(beyond[a, b])) for a in range(len(edges["x"]) + 1) for b in range(len(edges["y"]) + 1)], "p int, q int, n long")

    def within(by: str, other: str):
        def count(part: pa.Table) -> pa.Table:
            found = crossings(part.column(other).to_numpy(), part.column("y").to_numpy())
            return pa.table({"entity": part.column("entity").cast(pa.int64()), "n": pa.array(found)})

        #: A part with one value of its measure has nothing to count.
        several = rows.groupBy(F.col(by).alias("part")).agg(F.min("x" if by == "a" else "y").alias("low"), F.max("x" if by == "a" else "y").alias("high")).filter("low < high")
        return rows.join(F.broadcast(several.select("part")), F.col(by) == F.col("part"), "left_semi").groupBy(by).applyInArrow(count, "entity long, n long")

    apart = rows.join(F.broadcast(table), (F.col("a") == F.col("p")) & (F.col("b") == F.col("q"))).select(F.col("entity").cast("long"), "n")
    return apart.unionByName(within("a", "x")).unionByName(within("b", "a")).groupBy("entity").agg(F.sum("n").alias("overtaken_by")).withColumnRenamed("entity", entity)

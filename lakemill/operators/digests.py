"""Differences of two key sets by digests of key ranges: only ranges that differ move their keys.

A leaf is a range of 32,768 neighbouring keys. Its digest is the hash of the exact bitmap of the keys that it holds, so neither
the order of rows nor their repetition matters, and bitmaps are united before the shuffle. Digests of FAN leaves make a
node, and so on up to one root. Two trees are compared from the root down: children are looked at only under nodes that
differ, and keys are joined only in leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.functions.lineage import settle
from lakemill.operators.quality import set_diff

#: Children of a node: 2**FAN.
FAN = 8


def leaves(df: DataFrame, key: str) -> DataFrame:
    """(node, n, digest) for each leaf that has keys; null keys are in none."""
    rows = df.filter(F.col(key).isNotNull()).select(F.bitmap_bucket_number(F.col(key).cast("long")).alias("node"), F.bitmap_bit_position(F.col(key).cast("long")).alias("at"))
    return rows.groupBy("node").agg(F.bitmap_construct_agg("at").alias("bits")).select("node", F.bitmap_count("bits").alias("n"), F.xxhash64("bits").alias("digest"))


def tree(df: DataFrame, key: str) -> list[DataFrame]:
    """The levels of a side's tree, from the leaves up to a level of few nodes; each is written once."""
    levels = [settle(leaves(df, key))]
    while levels[-1].limit(2**FAN + 1).count() > 2**FAN:
        up = levels[-1].groupBy(F.shiftright("node", FAN).alias("node")).agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("node", "n", "digest")).alias("digest"))
        levels.append(settle(up))
    return levels


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    other = right.select(F.col("node").alias("m"), F.col("n").alias("k"), F.col("digest").alias("e"))
    same = F.col("n").eqNullSafe(F.col("k")) & F.col("digest").eqNullSafe(F.col("e"))
    return left.join(other, F.col("node") == F.col("m"), "full").filter(~same).select(F.coalesce("node", "m").alias("differs"))


def changed_leaves(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(differs): leaves whose keys are not the same on both sides. Below the top, only children of nodes that differ are compared."""
    height = min(len(left), len(right))
    found = _differing(left[height - 1], right[height - 1])
    for level in range(height - 2, -1, -1):
        found = settle(found)
        under = lambda side: side.join(found, F.shiftright("node", FAN) == F.col("differs"), "left_semi")  # noqa: B023, E731
        found = _differing(under(left[level]), under(right[level]))
    return settle(found)


def range_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """What ``set_diff`` gives, from the keys of the leaves that differ alone. A null key, in no leaf, is in the result of neither."""
    changed = changed_leaves(tree(left, key), tree(right, key))
    within = lambda df: df.select(key).join(changed, F.bitmap_bucket_number(F.col(key).cast("long")) == F.col("differs"), "left_semi")
    return set_diff(within(left), within(right), key)

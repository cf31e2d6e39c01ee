"""Sharding by longest-processing-time scheduling; equal texts stay together.

Groups of equal texts are sized, and groups of one size counted. The driver sees one row for each size that
occurs (there are fewer than the root of twice the bytes of all texts), not one for each group: from the
largest size on, each group goes to the shard with the least load, which a heap gives; groups of one size
that would go round and round are dealt in one step, with the same outcome. Within a size the groups are
numbered, in bins with offsets from the counts of the bins, and a number says which shard the group has.
Slots of a shard are numbered in the same way, so no task holds a whole shard or size.

Defined results: a null text counts as an empty one (size 1, checksum 0, the same group); repeated rows
are a group; with no rows there is no result row. Law: bytes, as near to equal as whole groups allow.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import accumulate
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.functions.lineage import settle
from lakemill.sources.tables import read_table

SHARDS = 8
#: Rows that one bin has when numbers are given out, roughly.
BIN_ROWS = 5_000
#: A group with at least this part of all rows is joined by a broadcast; there are at most as many as its inverse.
HOT_PART = 1 / 2_000
#: A table of sizes with at most so many rows may be broadcast.
BROADCAST_SIZES = 100_000


def dealt(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets, always the least loaded next, ties to the lower shard.

    The greedy rule takes the smallest of the numbers load + i * size of all shards. All of them below a
    level are taken at once, the highest level that leaves none too few, and the rest by a heap.
    """
    below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
    low, high = min(loads), max(loads) + size * (count // len(loads) + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle - 1)
    out = below(low)
    heap = [(x + n * size, shard) for shard, (x, n) in enumerate(zip(loads, out))]
    heapq.heapify(heap)
    for _ in range(count - sum(out)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[shard] += 1
    return out


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """Size to the number of its groups on each shard; ``sizes`` has each size with its number of groups."""
    loads, out = [0] * shards, {}
    for size, count in sorted(sizes, reverse=True):
        out[size] = dealt(loads, size, count)
        loads = [x + size * n for x, n in zip(loads, out[size])]
    return out


def numbered(df: DataFrame, by: list[str], order: list[str], bins: Column, into: str) -> DataFrame:
    """Gapless numbers from 0 for the rows with equal ``by``: a place in its bin, after the bins before."""
    binned = settle(df.withColumn("bin", F.pmod(F.xxhash64(*order, F.lit("bin")), bins).cast("long")))
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"o_{c}") for c in (*by, "bin")], before.alias("offset"))
    place = F.row_number().over(Window.partitionBy(*by, "bin").orderBy(*order)) - 1
    same = reduce(and_, [F.col(c) == F.col(f"o_{c}") for c in (*by, "bin")])
    joined = binned.withColumn("place", place).join(offsets, same).withColumn(into, (F.col("offset") + F.col("place")).cast("long"))
    return joined.select(*df.columns, into)


def shard_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(group, shard) for each group of ``groups`` (sha, bytes, rows)."""
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("groups")).toArrow()
    placed = longest_first(list(zip(sizes.column("bytes").to_pylist(), sizes.column("groups").to_pylist())), shards)
    #: For each size how many of its groups stand on this shard and the ones before it.
    table = pa.table({"size": pa.array(placed.keys(), pa.int64()), "upto": pa.array(map(list, map(accumulate, placed.values())), pa.list_(pa.int64()))})
    upto = groups.sparkSession.createDataFrame(table)
    upto = F.broadcast(upto) if len(placed) <= BROADCAST_SIZES else upto
    sized = groups.join(upto, F.col("bytes") == F.col("size")).select("sha", "rows", "bytes", "upto")
    bins = F.ceil(F.element_at("upto", -1) / BIN_ROWS)
    at = numbered(sized, ["bytes"], ["sha"], bins, "number")
    return at.select(F.col("sha").alias("group"), "rows", F.size(F.filter("upto", lambda x: x <= F.col("number"))).alias("shard"))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """For each row of ``docs``: key, size, text_crc32, shard and slot."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = settle(
        docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.unhex(F.sha2(body, 256)).alias("sha"))
    )
    groups = settle(rows.groupBy("sha").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    total = rows.count()
    placed = settle(shard_of_groups(groups, shards))
    hot = F.col("rows") >= max(2, total * HOT_PART)
    large = placed.filter(hot).select(F.col("group").alias("large"), F.col("shard").alias("large_shard"))
    marked = rows.join(F.broadcast(large), F.col("sha") == F.col("large"), "left")
    others = marked.filter("large is null").join(placed.filter(~hot), F.col("sha") == F.col("group"))
    columns = ["key", "size", "crc", "sha"]
    sharded = marked.filter("large is not null").select(*columns, F.col("large_shard").alias("shard")).unionByName(others.select(*columns, "shard"))
    slots = numbered(sharded, ["shard"], ["key", "crc", "sha"], F.lit(max(1, total // (shards * BIN_ROWS))), "slot")
    return slots.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )

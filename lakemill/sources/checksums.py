"""Checksums of files of any size, and what reads them.

A file of at most ``LEAF`` bytes has the SHA-256 of its content. A larger file is cut into leaves of that length,
NODE leaves make a node and the nodes the file: the checksum of a node is the SHA-256 of the checksums of its leaves (lowercase
hex, in order, joined), that of the file the SHA-256 of those of its nodes. Leaves are read by ranges, a piece at a
time, each range in a task of its own where there are enough: no cell and no task holds a file, and a lost executor costs its ranges.

Small files are read by Spark, from any store that it reads; ranges of large ones by pyarrow's file systems, which know local
paths, HDFS, S3 and Google's and Azure's stores. A file that is shorter than listed when its range is read is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = 256 << 20
PIECE = 4 << 20
NODE = 1024


def listed(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The Parquet files under a folder, but for empty ones, which Spark's reader passes over; their content is read only where it is asked for."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(path)


def _opened(path: str):
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if colon else path).lstrip("/"))
    system, place = fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + quote(rest))
    return system.open_input_file(place)


def range_digest(path: str, start: int, length: int) -> str:
    """SHA-256 of ``length`` bytes from ``start``; never more than a piece is held."""
    digest, left = hashlib.sha256(), length
    with _opened(path) as file:
        file.seek(start)
        while left:
            piece = file.read(min(PIECE, left))
            if not piece:
                raise OSError(f"{path} ends {left} bytes before {start + length}")
            digest.update(piece)
            left -= len(piece)
    return digest.hexdigest()


def _joined(order: str, digest: str) -> Column:
    """SHA-256 of the group's checksums in order; at most NODE of them, or one for each NODE leaves of a file."""
    return F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.struct(order, digest)))[digest]).cast("binary"), 256)


def checksums(files: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(path, bytes, sha256) of the files that ``listed`` gives."""
    # A filter of the length reaches the source, which then opens no larger file.
    small = files.filter(F.col("length") <= leaf).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > leaf).select("path", F.col("length").alias("bytes"))
    places = large.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / leaf))).alias("place"))
    # A fixed number of partitions, since adaptive execution would gather these few bytes into one task.
    spread = places.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "place")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            digests = [range_digest(p, i * leaf, min(leaf, n - i * leaf)) for p, n, i in zip(rows["path"], rows["bytes"], rows["place"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "bytes", "place", "digest"])

    leaves = spread.mapInArrow(hashed, "path string, bytes long, place long, digest string")
    nodes = leaves.groupBy("path", "bytes", F.floor(F.col("place") / NODE).alias("node")).agg(_joined("place", "digest").alias("digest"))
    return small.unionByName(nodes.groupBy("path", "bytes").agg(_joined("node", "digest").alias("sha256")))

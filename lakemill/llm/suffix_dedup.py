"""Deduplication of long byte strings with suffix arrays in a logarithmic family of levels.

A window is WINDOW consecutive bytes of one text. Every window has an anchor: the place with the smallest hash of a
gram among the first places of the window. Equal windows have equal anchors, so only suffixes that start at an anchor
are indexed, about one for each REACH / 2 bytes. Consecutive windows with one anchor form a gap.

Documents come in batches. The suffixes of a batch are sorted into a suffix array of their first CONTEXT bytes, which
each window of a gap holds, with the number of places of each. The array is scanned against the levels of the family
for the suffixes that both hold, as a sort-merge join of two tables that are bucketed and sorted alike, so that no
level is shuffled. Then the array becomes a level itself. Before a batch comes, levels of equal size are merged two by
two, from the smallest on: N batches leave about log2 N levels, and a suffix is written again about log2 N times.

Suffixes that match are candidates: the windows around them are compared in full. A gap all of whose bytes stand in
another place too repeats as a whole. Else its windows are taken in blocks of BLOCK: a block whose common bytes stand
nowhere else holds no repeat, one all of whose bytes stand elsewhere repeats as a whole, and only what lies between (the
ends of a passage) is compared window by window. For that, the bytes of each different gap are moved once.

Bytes are compared by 128-bit hashes (XXH3); hashes of 64 bits only rule out. Texts with equal hashes (MD5) are taken
as equal. A hot suffix (a passage in a third of all texts) is one entry of an array; a hot text is dealt by salts.

Defined results: a null text is empty. Nothing is removed from texts shorter than a window. Repeated rows are places
of their own, so texts of a window or more that stand twice lose all. Windows are judged on the input. Without rows there
is no result row. Keys may be null or repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.lineage import shared_folder
from lakemill.llm.batches import slices_of, text_bytes
from lakemill.llm.hashing import mixed
from lakemill.sources.tables import read_table

WINDOW = 400
#: Grams among which a window's anchor is found, and bytes of a gram.
REACH, GRAM = 320, 8
CONTEXT = WINDOW - REACH + 1
#: Windows of a block.
BLOCK = 32
#: Batches into which a table is dealt, and suffixes in a bucket of a level.
BATCHES = 4
BUCKET_ROWS = 1_000_000
#: Parts over which the rows of one text are dealt.
SALTS = 4
#: Window starts that one step of numpy covers.
STEP = 1_000_000


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write are removed when it is done."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Folder:
    """Intermediate tables of one run, in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/suffixes-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, mode: str = "error") -> DataFrame:
        with shuffles_removed(self.spark):
            df.write.mode(mode).option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(hadoop).delete(path, True)


def least_place(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by running minima forwards and backwards over tiles of that width."""
    n = len(values) - width + 1
    tiles = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    tiles[: len(values)] = values
    tiles = tiles.reshape(-1, width)
    forward = np.minimum.accumulate(tiles, axis=1).ravel()
    backward = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def gaps(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and anchor of each gap of the texts that ``data`` holds one after another (``ends``: n + 1 bounds)."""
    low, high = ends[:-1], ends[1:] - WINDOW + 1
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, low[high > low], 1)
    np.add.at(inside, high[high > low], -1)
    starts = np.flatnonzero(np.cumsum(inside))
    if not len(starts):
        return starts, starts, starts
    gram = np.zeros(len(data) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        gram |= data[i : i + len(gram)].astype(np.uint64) << np.uint64(8 * i)
    #: The place fills the low bits, so that of equal hashes the first wins.
    bits = np.uint64(24)
    values = (mixed(gram) >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    anchor = (least_place(values, REACH)[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(starts) > 1) | (np.diff(anchor) != 0)])
    last = np.r_[first[1:], len(starts)] - 1
    return starts[first], starts[last], anchor[first]


def gap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, th, key, lo, hi, at, suffix, whole) of the texts of (batch, th, key, text)."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in slices_of(texts, STEP):
            data, ends = text_bytes(texts[a:b])
            for base in range(0, max(1, len(data)), STEP) if b == a + 1 else (0,):
                part = data[base : base + STEP + WINDOW - 1] if b == a + 1 else data
                bounds = np.array([0, len(part)]) if b == a + 1 else ends
                lo, hi, at = gaps(part, bounds)
                if not len(lo):
                    continue
                row = pa.array(a + np.searchsorted(bounds, lo, side="right") - 1)
                begin = np.zeros(1, np.int64) if b == a + 1 else bounds[row.to_numpy() - a]
                view = memoryview(np.ascontiguousarray(part))
                suffix = part[at[:, None] + np.arange(CONTEXT)]
                yield pa.record_batch(
                    {
                        **{c: batch.column(c).take(row) for c in ("batch", "th", "key")},
                        **{c: pa.array(v - begin + base) for c, v in (("lo", lo), ("hi", hi), ("at", at))},
                        "suffix": pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * CONTEXT), pa.py_buffer(suffix.tobytes())]),
                        "whole": pa.array([xxhash.xxh3_128_digest(view[x : y + WINDOW]) for x, y in zip(lo.tolist(), hi.tolist())], pa.binary()),
                    }
                )


class SuffixIndex:
    """A logarithmic family of suffix arrays. A level is a table (suffix, times), bucketed and sorted by suffix."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        #: (how many batches it holds, name), from the largest on.
        self.levels: list[tuple[int, str]] = []

    def _written(self, array: DataFrame) -> str:
        name = f"suffix_level_{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            array.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "suffix").sortBy("suffix").saveAsTable(name)
        return name

    def merge(self) -> None:
        """Merges the two smallest levels while they are of equal size, by a scan of both in order."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, other) = self.levels.pop(), self.levels.pop()
            left, right = self.spark.table(one), self.spark.table(other).select(F.col("suffix").alias("s"), F.col("times").alias("t"))
            both = left.hint("merge").join(right, F.col("suffix") == F.col("s"), "full")
            name = self._written(both.select(F.coalesce("suffix", "s").alias("suffix"), (F.coalesce("times", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("times")))
            self.levels.append((2 * size, name))
            for old in (one, other):
                self.spark.sql(f"DROP TABLE {old}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes the suffixes of a batch in; gives those that stand twice in it or in an earlier batch too.

        The result is to be used before the next call.
        """
        self.merge()
        name = self._written(batch.groupBy("suffix").agg(F.count(F.lit(1)).alias("times")))
        array = self.spark.table(name)
        found = array.filter("times > 1").select("suffix")
        for _, level in self.levels:
            found = found.unionAll(array.select("suffix").hint("merge").join(self.spark.table(level).select("suffix"), "suffix", "left_semi"))
        self.levels.append((1, name))
        return found

    def drop(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def places_of(known: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``known`` whose suffix is among ``found``.

    ``found`` may repeat: an aggregate between its shuffle and the join would keep Spark from splitting a hot suffix.
    """
    return known.join(found.select(F.col("suffix").alias("again")), F.col("suffix") == F.col("again"), "left_semi")


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of gaps: (whole, alone, anchor, bytes) from (whole, alone, lo, hi, at, text)."""
    for batch in batches:
        for a, b in slices_of(batch.column("text"), STEP):
            data, ends = text_bytes(batch.column("text")[a:b])
            lo, hi = (batch.column(c)[a:b].to_numpy() for c in ("lo", "hi"))
            cut = [data[s + x : s + y + WINDOW].tobytes() for s, x, y in zip(ends.tolist(), lo.tolist(), hi.tolist())]
            anchor = batch.column("at")[a:b].to_numpy() - lo
            yield pa.record_batch({"whole": batch.column("whole")[a:b], "alone": batch.column("alone")[a:b], "anchor": pa.array(anchor), "bytes": pa.array(cut, pa.binary())})


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of windows of each gap, counted back from the anchor: hash of the bytes that all windows of a whole block share, of all its bytes."""
    for batch in batches:
        out: list[tuple] = []
        for whole, alone, anchor, data in zip(*(batch.column(c).to_pylist() for c in ("whole", "alone", "anchor", "bytes"))):
            count = len(data) - WINDOW + 1
            for block in range((anchor - count + 1) // BLOCK, anchor // BLOCK + 1):
                first, last = max(0, anchor - (block + 1) * BLOCK + 1), min(count - 1, anchor - block * BLOCK)
                core = data[anchor - block * BLOCK : anchor - (block + 1) * BLOCK + 1 + WINDOW]
                cover = xxhash.xxh3_128_digest(b"%d:" % (anchor - first) + data[first : last + WINDOW])
                out.append((whole, alone, first, last, xxhash.xxh3_64_intdigest(core) - 2**63, cover))
        yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(BLOCKS)], schema=BLOCKS)


BLOCKS = pa.schema([("whole", pa.binary()), ("alone", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("core", pa.int64()), ("cover", pa.binary())])


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the blocks (first, last) of a gap: (whole, alone, first, window)."""
    for batch in batches:
        out: list[tuple] = []
        for whole, alone, data, blocks in zip(*(batch.column(c).to_pylist() for c in ("whole", "alone", "bytes", "blocks"))):
            for b in blocks:
                out += [(whole, alone, i, xxhash.xxh3_128_digest(data[i : i + WINDOW])) for i in range(b["first"], b["last"] + 1)]
        yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(WINDOWS)], schema=WINDOWS)


WINDOWS = pa.schema([("whole", pa.binary()), ("alone", pa.bool_()), ("first", pa.int64()), ("window", pa.binary())])


def twice(rows: DataFrame, column: str, of: Column | None = None) -> DataFrame:
    """The values of ``column`` in more than one row, one at least with ``of``, under the name ``again``."""
    some = F.max(of) if of is not None else F.lit(True)
    return rows.groupBy(F.col(column).alias("again")).agg(F.count(F.lit(1)).alias("n"), some.alias("some")).filter("n > 1 AND some").select("again")


def repeated_windows(hits: DataFrame, docs: DataFrame, folder: Folder) -> DataFrame:
    """(whole, a, z): windows of a gap, by first and last start from the gap's first, that stand elsewhere too; z is null for all."""
    place = F.min(F.struct("th", "key", "lo", "hi", "at")).alias("place")
    wholes = folder.put("wholes", hits.groupBy("suffix", "whole").agg(F.count(F.lit(1)).alias("n"), place))
    several = wholes.groupBy(F.col("suffix").alias("s")).agg(F.count(F.lit(1)).alias("wholes"), F.min("n").alias("least")).filter("wholes > 1 AND least = 1").select("s")
    asked = wholes.join(several, F.col("suffix") == F.col("s"), "left_semi").select("whole", (F.col("n") == 1).alias("alone"), "place.*")
    named = asked.withColumnsRenamed({"th": "t", "key": "k"})
    texts = docs.select("th", "key", "text").join(named, (F.col("th") == F.col("t")) & F.col("key").eqNullSafe(F.col("k")))
    cut = texts.select("whole", "alone", "lo", "hi", "at", "text").mapInArrow(cut_rows, "whole binary, alone boolean, anchor long, bytes binary")
    pieces = folder.put("pieces", cut.dropDuplicates(["whole"]))
    blocks = folder.put("blocks", pieces.mapInArrow(block_rows, "whole binary, alone boolean, first long, last long, core long, cover binary"))
    shared = blocks.join(twice(blocks, "core", F.col("alone")), F.col("core") == F.col("again"), "left_semi")
    covered = twice(shared, "cover", F.col("alone"))
    judged = folder.put("judged", shared.join(covered, F.col("cover") == F.col("again"), "left").withColumn("done", F.col("again").isNotNull()).drop("again", "cover"))
    open_cores = judged.filter("alone AND NOT done").select(F.col("core").alias("c")).distinct()
    left = judged.join(open_cores, F.col("core") == F.col("c"), "left_semi").groupBy(F.col("whole").alias("w")).agg(F.collect_list(F.struct("first", "last")).alias("blocks"))
    windows = pieces.join(left, F.col("whole") == F.col("w")).select("whole", "alone", "bytes", "blocks").mapInArrow(window_rows, "whole binary, alone boolean, first long, window binary")
    windows = folder.put("windows", windows)
    folder.drop("pieces", "blocks")
    single = windows.filter("alone").join(twice(windows, "window", F.col("alone")), F.col("window") == F.col("again"), "left_semi")
    answers = wholes.filter("n > 1").select("whole", F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("z"))
    answers = answers.unionAll(judged.filter("alone AND done").select("whole", F.col("first").alias("a"), F.col("last").alias("z")))
    return answers.unionAll(single.select("whole", F.col("first").alias("a"), F.col("first").alias("z")))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))
def united(starts: pa.Array) -> pa.Array:
    """The spans that windows cover, from ranges (a, z) of their starts."""
    out = []
    for ranges in starts.to_pylist():
        spans: list[dict] = []
        for a, z in sorted((r["a"], r["z"] + WINDOW) for r in ranges):
            if spans and a <= spans[-1]["stop"]:
                spans[-1]["stop"] = max(spans[-1]["stop"], z)
            else:
                spans.append({"start": a, "stop": z})
        out.append(spans)
    return pa.array(out, SPANS)


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_bytes, n_removed, n_spans, kept, spans) from (key, text, spans)."""
    for batch in batches:
        out, held = [], 0
        for key, text, found in zip(*(batch.column(c) for c in ("key", "text", "spans"))):
            data, spans = text.as_buffer().to_pybytes() if text.is_valid else b"", found.as_py() or []
            edges = [0, *(x for s in spans for x in (s["start"], s["stop"])), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((key.as_py(), len(data), len(data) - len(kept), len(spans), kept, spans))
            held += len(kept)
            if held > STEP:
                yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(KEPT)], schema=KEPT)
                out, held = [], 0
        yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(KEPT)], schema=KEPT)


KEPT = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", SPANS)])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept (the bytes that are left) and spans (those that are not)."""
    spark = docs.sparkSession
    folder = Folder(spark)
    th = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), th.alias("th"))
    dealt = rows.filter(F.octet_length("text") >= WINDOW).withColumn("batch", F.pmod(F.xxhash64("th", "key"), F.lit(batches)).cast("int"))
    columns = "batch int, th binary, key long, lo long, hi long, at long, suffix binary, whole binary"
    known = folder.put("gaps", dealt.select("batch", "th", "key", "text").mapInArrow(gap_rows, columns))
    index = SuffixIndex(spark, max(8, -(-known.count() // BUCKET_ROWS)))
    found = None
    for batch in range(batches):
        found = folder.put("found", index.add(known.filter(F.col("batch") == batch).select("suffix")), "append")
    index.drop()
    hits = folder.put("hits", places_of(known, found).drop("batch"))
    folder.drop("gaps", "found")
    answers = folder.put("answers", repeated_windows(hits, rows, folder).withColumnRenamed("whole", "w"))
    folder.drop("wholes", "judged", "windows")
    places = hits.select("th", "lo", "hi", "whole").distinct().join(answers, F.col("whole") == F.col("w"))
    starts = F.collect_set(F.struct((F.col("lo") + F.col("a")).alias("a"), F.coalesce(F.col("lo") + F.col("z"), "hi").alias("z")))
    spans = folder.put("spans", places.groupBy(F.col("th").alias("t")).agg(united(starts).alias("spans")))
    folder.drop("hits", "answers")
    dealt = spans.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    joined = salted.join(dealt, (F.col("th") == F.col("t")) & (F.col("salt") == F.col("s")), "left").select("key", "text", "spans")
    return joined.mapInArrow(kept_rows, "key long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, stop: long>>")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Mixing sources to target weights with hash-threshold histograms, on DataFrame functions alone.

Targets: the sources' weights share out the whole size; a source may give ``repeats`` times its own
size at most, and what it cannot give goes to the others by weight. The level at which the sources
fill up is found in closed form from running sums over the sources.

A source with target T and size S gives every document T div S times; the rest comes from the
documents whose hash lies under a threshold. The thresholds come from a histogram of the size by
source and hash bucket; only the bucket in which a source's budget ends is cut into finer buckets,
level by level. Nothing is sorted but histograms, and thresholds for smaller budgets select subsets.

Rows with equal key and text share one hash. Where a budget ends among them, a second hash, of the row, cuts
their class in the same way, so that as many of them come as bring the source nearest to its target. Which of
them come makes no difference, since they are equal.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its
own, after all others; repeated rows come equally often, or some of them once more. Without any row, no row comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.functions.lineage import settle
from lakemill.sources.tables import read_table

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Bits of the hash that one level of the histogram resolves, and the number of levels.
LEVEL_BITS = 12
LEVELS = 4
HASH_BITS = LEVEL_BITS * LEVELS
#: A table of thresholds with at most so many sources may be broadcast.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text: places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) with a target for each; one row a source, so small.

    With the sources in order of the level at which they fill up, repeats * size / weight, the level
    that holds is the first at which the full ones leave no more to share than the next can take.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everywhere = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everywhere) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    levels = ranked.withColumn("level", left / open_weight)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    chosen = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everywhere)["level"]
    target = F.least(F.col("cap"), F.col("weight") * chosen)
    return levels.withColumn("target", F.coalesce(target, F.col("cap"))).select("source", "source_size", "target")


def narrow(rows: DataFrame, state: DataFrame, by: str, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``state`` (source, rest) with the value of ``by``, at {by}_at, at which the rest of each source's budget ends.

    ``rows`` has source, size and ``by`` (HASH_BITS bits); what then remains in ``rest`` is for the rows with
    this very value, of which the result gives the size and the number.
    """
    kept = [c for c in state.columns if c not in ("rest", "cell", "rows")]
    at = f"{by}_at"
    state = state.withColumn(at, F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = rows
        if level:
            here = state.select(F.col("source").alias("s"), F.col(at).alias("p"))
            inside = rows.join(small(here), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright(by, shift + LEVEL_BITS) == F.col("p")), "left_semi")
        cells = inside.groupBy(F.col("source").alias("s"), F.shiftright(by, shift).alias("bucket")).agg(F.sum("size").alias("cell"), F.count(F.lit(1)).alias("rows"))
        earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        run = cells.withColumn("before", F.coalesce(F.sum("cell").over(earlier), F.lit(0)))
        #: The bucket in which the rest of the budget ends: the last that begins within it.
        budget = state.select(F.col("source").alias("q"), "rest")
        ends = run.join(small(budget), F.col("s").eqNullSafe(F.col("q"))).filter(F.col("before") <= F.col("rest"))
        edge = ends.groupBy("s").agg(F.max(F.struct("bucket", "before", "cell", "rows")).alias("edge"))
        of = lambda name: F.coalesce(F.col(f"edge.{name}"), F.lit(0))
        place = F.coalesce(F.col("edge.bucket"), F.shiftleft(at, LEVEL_BITS)).alias(at)
        joined = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        state = settle(joined.select(*kept, (F.col("rest") - of("before")).alias("rest"), place, of("cell").alias("cell"), of("rows").alias("rows")))
    return state


def budgets(targets: DataFrame) -> DataFrame:
    """Whole repeats of each source and the rest of its budget; none is left to a source that whole repeats use up, not even for empty texts."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("repeats") * F.col("source_size")
    return targets.withColumn("repeats", full).withColumn("rest", rest).withColumn("partly", F.col("rest") > 0)


def on_edge() -> Column:
    """Rows of the hash at which their source's budget ends."""
    return F.col("partly") & (F.col("h") == F.col("h_at"))


def copies(state: DataFrame) -> Column:
    """How often a row with ``h`` (and ``u``, where the edge was split) comes; the last class comes along where that brings the sum nearer to the budget."""
    along = (2 * F.col("rest") >= F.col("cell")) & (F.col("cell") > 0)
    last = F.col("u") < F.col("u_at") + along.cast("long") if "u_at" in state.columns else along
    more = F.col("partly") & ((F.col("h") < F.col("h_at")) | ((F.col("h") == F.col("h_at")) & last))
    return (F.col("repeats") + more.cast("long")).cast("long")


def splits(state: DataFrame) -> bool:
    """Whether repeated rows of a text stand where a budget ends, so that some of them come and others not."""
    return state.filter("partly and rows > 1 and cell > 0").limit(1).count() > 0


def mix_hash(key: str, text: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text), F.lit("mix")), 64 - HASH_BITS)


def row_hash() -> Column:
    """Tells repeated rows apart; only of use once the frame is written."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit("row")), 64 - HASH_BITS)


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The texts are read once; what the histograms need of them is small."""
    return settle(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), mix_hash(key, text).alias("h"), row_hash().alias("u")))


def cuts(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Where each source's budget ends, one row a source, and how to send that: broadcast if it has few sources, by a shuffle otherwise."""
    sources = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = settle(source_targets(sources, weights, repeats))
    small = F.broadcast if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else (lambda df: df)
    return narrow(sized, budgets(targets), "h", small), small


def beside(rows: DataFrame, state: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each row with the state of its source."""
    return rows.join(small(state.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row for each row of ``docs``: key, size, source_size, target, and copies, the times that the mix takes it."""
    sized = sizes(docs, key, text, source)
    state, small = cuts(sized, weights, repeats)
    if splits(state):
        edge = beside(sized, state.select("source", "partly", "h_at"), small).filter(on_edge()).select("source", "size", "u")
        state = narrow(edge, state, "u", small)
    return beside(sized, state, small).select(F.col("key").alias(key), "size", "source_size", "target", copies(state).alias("copies"))


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as the mix takes it, with the columns that came."""
    state, small = cuts(sizes(docs, key, text, source), weights, repeats)
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    rows = docs.select(kept.alias("row"), F.col(source).alias("source"), mix_hash(key, text).alias("h"))
    joined = beside(rows, state, small)
    taken = joined.select("row", copies(state).alias("n"))
    if splits(state):
        #: Repeated rows at the edge are written, so that each keeps what tells it from the others.
        edge = joined.filter(on_edge()).select("row", "source", "h", word_count(F.col("row")[text]).alias("size"), row_hash().alias("u"))
        edge = settle(edge)
        parted = narrow(edge.select("source", "size", "u"), state, "u", small)
        taken = joined.filter(~on_edge()).select("row", copies(state).alias("n")).unionByName(beside(edge, parted, small).select("row", copies(parted).alias("n")))
    return taken.filter("n > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("copy")).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

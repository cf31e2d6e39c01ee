"""Which load events cover a landing artifact: its own loads, and replays of everything whose span holds its window.

An artifact is one table and business day, known by its extract batch. A load of a day names that batch. A replay of
everything names none: it covers an artifact whose window lies within its span and whose extract had ended when it began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.operators.intervals import blocks_of_day, blocks_of_span
from lakemill.sources.adapters import ZONE_HOURS

REPLAY = "replay_all"
PASSED = ("loaded", "replayed")
#: What is kept of an event; structs compare from the left, so the greatest is the last.
EVENT = ("started_at", "finished_at", "load_batch_id", "run_mode", "status", "parquet_rows", "bronze_rows")


def artifacts(manifest: DataFrame) -> DataFrame:
    """One row for each artifact of a manifest, which has a row for each file."""
    return manifest.groupBy("table_name", "dt", "batch_id").agg(F.max("source_rows").alias("source_rows"), F.max("parquet_rows").alias("parquet_rows"), F.max("finished_at").alias("extracted_at"))


def _loads(audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loads of one artifact, replays of everything), each with its ``event``."""
    loads = audit.filter("load_batch_id is not null").withColumn("event", F.struct(*EVENT))
    return loads.filter(~F.col("run_mode").eqNullSafe(F.lit(REPLAY))), loads.filter(F.col("run_mode") == REPLAY)


def _replayed_blocks(replays: DataFrame) -> DataFrame:
    """(t, block, event): the blocks of whole business days that each replay spans."""
    local = lambda c: F.col(c) + F.make_dt_interval(F.lit(0), F.lit(ZONE_HOURS))
    day = local("window_start").cast("date")
    first = F.when(local("window_start") > day.cast("timestamp_ntz"), F.date_add(day, 1)).otherwise(day)
    return replays.select(F.col("table_name").alias("t"), F.explode(blocks_of_span(first, local("window_end").cast("date"))).alias("block"), "event")


def last_loads(manifest: DataFrame, audit: DataFrame) -> DataFrame:
    """Each artifact with ``last``, the last event that covers it, or null.

    Of the replays of a block only the last is kept before the join: if that began before the extract had ended, so did the others.
    """
    known, (own, replays) = artifacts(manifest), _loads(audit)
    mine = own.groupBy(F.col("table_name").alias("t"), F.col("extract_batch_id").alias("b")).agg(F.max("event").alias("own"))
    blocks = _replayed_blocks(replays).groupBy("t", "block").agg(F.max("event").alias("replay"))
    days = known.select("table_name", "dt", "batch_id", "extracted_at", F.explode(blocks_of_day(F.col("dt"))).alias("at"))
    over = days.join(blocks, (F.col("table_name") == F.col("t")) & (F.col("at") == F.col("block"))).filter(F.col("replay.started_at") >= F.col("extracted_at"))
    over = over.groupBy(F.col("table_name").alias("t2"), F.col("dt").alias("d2"), F.col("batch_id").alias("b2")).agg(F.max("replay").alias("over"))
    joined = known.join(mine, (F.col("table_name") == F.col("t")) & (F.col("batch_id") == F.col("b")), "left")
    same = (F.col("table_name") == F.col("t2")) & (F.col("dt") == F.col("d2")) & F.col("batch_id").eqNullSafe(F.col("b2"))
    return joined.join(over, same, "left").select(*known.columns, F.greatest("own", "over").alias("last"))


def reconcile_covered(manifest: DataFrame, audit: DataFrame, problems: DataFrame) -> DataFrame:
    """For each artifact: its landing problems, the last event that covers it, and whether all is well.

    ``problems`` (table_name, dt, problem) is what the proof of the landing files found; one without a day counts for all
    days of the table. A replay loads many artifacts in one job, so its own two counts are compared; a load's count is
    compared with the artifact. An artifact that nothing has loaded yet is well if its own counts agree.
    """
    c = F.col
    of_day = problems.filter("dt is not null").groupBy(c("table_name").alias("t"), c("dt").alias("d")).agg(F.count(F.lit(1)).alias("here"))
    of_table = problems.filter("dt is null").groupBy(c("table_name").alias("t2")).agg(F.count(F.lit(1)).alias("everywhere"))
    joined = last_loads(manifest, audit).join(of_day, (c("table_name") == c("t")) & (c("dt") == c("d")), "left").join(F.broadcast(of_table), c("table_name") == c("t2"), "left")
    wanted = F.when(c("last.run_mode") == REPLAY, c("last.parquet_rows")).otherwise(c("parquet_rows"))
    loaded = F.coalesce(c("last.status").isin(*PASSED) & (c("last.bronze_rows") == wanted), F.lit(False))
    found = F.coalesce("here", F.lit(0)) + F.coalesce("everywhere", F.lit(0))
    well = (found == 0) & F.coalesce(c("source_rows") == c("parquet_rows"), F.lit(False)) & (c("last").isNull() | loaded)
    return joined.select(
        "table_name", "dt", "batch_id", "source_rows", "parquet_rows", found.alias("landing_problems"), c("last.run_mode").alias("last_mode"), c("last.load_batch_id").alias("last_load"),
        c("last.status").alias("last_status"), c("last.bronze_rows").alias("last_rows"), well.alias("passed"),
    )


def load_statuses(manifest: DataFrame, audit: DataFrame) -> DataFrame:
    """The loads of single artifacts with the status that they deserve: mismatch where rows were lost, replayed where the artifact
    had been loaded well before, by itself or in a replay of everything that began no later, else loaded.

    Replays of a block and loads that ask it go through one window in the order of their starts. Blocks of other sizes than those
    of the replays are left out first, so few blocks are asked, however many loads there are.
    """
    c = F.col
    own, replays = _loads(audit)
    extracted = artifacts(manifest).select(c("table_name").alias("t"), c("batch_id").alias("b"), "dt", "extracted_at", c("parquet_rows").alias("wanted"))
    asked = own.drop("dt", "parquet_rows").join(extracted, (c("table_name") == c("t")) & (c("extract_batch_id") == c("b"))).drop("t", "b")
    wrong = ~(c("bronze_rows") == c("wanted"))
    #: A load's own count says whether it went well; the audit's word on it is what is asked for here.
    earlier = F.max(F.when(~wrong, 1)).over(Window.partitionBy("table_name", "extract_batch_id").orderBy("started_at", "load_batch_id").rowsBetween(Window.unboundedPreceding, -1))
    asked = asked.withColumn("before", F.coalesce(earlier, F.lit(0)))
    good = _replayed_blocks(replays.filter(c("status").isin(*PASSED))).select(c("t").alias("table_name"), "block", c("event.started_at").alias("at"), F.lit(0).alias("asks"))
    held = good.select(c("table_name").alias("t"), c("block").alias("k")).distinct()
    questions = asked.select("table_name", "extract_batch_id", "load_batch_id", "extracted_at", c("started_at").alias("at"), F.explode(blocks_of_day(c("dt"))).alias("block"))
    questions = questions.join(held, (c("table_name") == c("t")) & (c("block") == c("k")), "left_semi").withColumn("asks", F.lit(1))
    both = good.unionByName(questions, allowMissingColumns=True)
    latest = F.max(F.when(c("asks") == 0, c("at"))).over(Window.partitionBy("table_name", "block").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, -1))
    replayed = both.withColumn("latest", latest).filter("asks = 1 and latest >= extracted_at").select(c("table_name").alias("t"), c("extract_batch_id").alias("b"), c("load_batch_id").alias("l"), F.lit(1).alias("over")).distinct()
    joined = asked.join(replayed, (c("table_name") == c("t")) & (c("extract_batch_id") == c("b")) & (c("load_batch_id") == c("l")), "left")
    status = F.when(F.coalesce(wrong, F.lit(True)), "mismatch").when((c("before") == 1) | c("over").isNotNull(), "replayed").otherwise("loaded")
    return joined.select("table_name", "dt", "extract_batch_id", "load_batch_id", "started_at", "bronze_rows", c("wanted").alias("parquet_rows"), status.alias("status"))


def coverage(manifest: DataFrame) -> tuple[Column, Column]:
    """Aggregates that give the span of a replay of all that the manifest names."""
    return F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end")

"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.lineage import shared_folder
from lakemill.llm import bpe, jaccard_join, mixing, quality_rules, substring_dedup
from lakemill.sources.tables import read_table

#: SQL cannot express the encoding of the last stage; the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; n_chars follows the text."""
    done = substring_dedup.strip_repeats(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else done


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of the sources takes it."""
    return mixing.take(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: sizes and checksums of the ids and of the decoded texts."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with what lies between them in the shared folder."""
    shared = shared_folder(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

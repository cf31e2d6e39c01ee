"""Removal of repeated byte strings against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakemill.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, key int, th string, suffix string"


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[i : i + sd.WINDOW] for _, d in data for i in range(len(d) - sd.WINDOW + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - sd.WINDOW + 1):
            if count[d[k : k + sd.WINDOW]] > 1:
                gone[k : k + sd.WINDOW] = b"\1" * sd.WINDOW
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["key"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


def dedup(spark, rows, **more):
    return sd.dedup(spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA), **more)


def prose(rng, n):
    return "".join(rng.choice(["tion ", "é", "wh", "an", "the ", "qu", ". ", "\n", "日本"]) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (120, 160, 190, 230, 400, 900)]
    rows = []
    for i in range(70):
        text = prose(rng, rng.randint(0, 500))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            passage = rng.choice(shared)
            at = rng.randint(0, len(passage) // 3)
            text += passage[at : len(passage) - rng.randint(0, at)] + prose(rng, rng.choice([0, 1, 300]))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_equal_to_all_windows(spark, batches):
    rows = corpus(batches)
    assert found(dedup(spark, rows, batches=batches)) == brute(rows)


def test_edges_of_a_window_and_repeats_in_one_text(spark):
    rng = random.Random(5)
    a, b = (prose(rng, 600).encode().decode("utf-8", "ignore") for _ in range(2))
    exact, short = "".join(f"{i:04d}" for i in range(100)), "".join(f"{i:04d}" for i in range(100))[:399]
    rows = [(0, f"x{exact}y"), (1, f"z{exact}w"), (2, f"{short}!"), (3, f"{a}1{a}2{b}"), (4, "ab" * 900), (5, "c" * 1500), (6, "d" * 400), (7, "e" * 401)]
    assert found(dedup(spark, rows)) == brute(rows)


def test_nulls_repeated_rows_and_keys(spark):
    text = prose(random.Random(9), 400)
    rows = [(1, None), (2, ""), (None, text), (None, text), (3, text[:300]), (4, text + "tail"), (4, text + "tail"), (4, "other" + text), (5, "short")] + [(i, text) for i in range(50, 90)]
    assert found(dedup(spark, rows)) == brute(rows)


def test_empty_tables(spark):
    assert dedup(spark, []).collect() == []
    assert found(dedup(spark, [(1, None), (2, "word")])) == brute([(1, None), (2, "word")])


def test_very_long_texts_over_several_steps(spark, monkeypatch):
    monkeypatch.setattr(sd, "STEP", 5000)
    rng = random.Random(11)
    long = prose(rng, 12_000)
    rows = [(1, long), (2, prose(rng, 3000) + long[9000:15_000]), (3, long[:7000] + "x" + long[7000:9000]), (4, "word " * 3000)]
    assert found(dedup(spark, rows)) == brute(rows)


def test_levels_are_merged_by_size(spark):
    index = sd.SuffixIndex(spark, 8)
    sizes = []
    for i in range(7):
        batch = spark.createDataFrame([(f"s{k}".encode(),) for k in (i, i, 100)], "suffix binary")
        got = {r["suffix"] for r in index.add(batch).collect()}
        assert got == {f"s{i}".encode()} | ({b"s100"} if i else set())
        index.merge()
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    assert {r["suffix"]: r["times"] for r in spark.table(index.levels[0][1]).collect()} == {b"s100": 4} | {f"s{i}".encode(): 2 for i in range(4)}
    index.add(spark.createDataFrame([(b"s100",)], "suffix binary"))
    plan = index.spark.table(index.levels[-1][1]).hint("merge").join(spark.table(index.levels[0][1]), "suffix")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


def test_places_of_a_hot_suffix_are_split_over_tasks(spark, tmp_path):
    sizes = {"skewJoin.skewedPartitionThresholdInBytes": "16k", "skewJoin.skewedPartitionFactor": "1.5", "advisoryPartitionSizeInBytes": "16k", "coalescePartitions.enabled": "false"}
    settings = {f"spark.sql.adaptive.{k}": v for k, v in sizes.items()} | {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k, None) for k in settings}
    suffix = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).cast("binary").alias("suffix")
    spark.range(0, 60_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 512).alias("more"), suffix).write.parquet(f"{tmp_path}/known")
    spark.createDataFrame([(b"hot",), (b"hot",), (b"3",), (b"none",)], "suffix binary").write.parquet(f"{tmp_path}/found")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hits = sd.places_of(spark.read.parquet(f"{tmp_path}/known"), spark.read.parquet(f"{tmp_path}/found"))
        rows = [r["id"] for r in hits.select("id").collect()]
        tasks = [r["count"] for r in hits.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(rows) == [i for i in range(60_000) if i % 3 or i == 3]
    assert max(tasks) < 0.5 * sum(tasks)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    df = sd.op13_suffix_dedup(spark, sf)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)

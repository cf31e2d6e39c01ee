"""The quality classifier against a plain scorer, on every row of the given tables, and its held-out accuracy."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right

import numpy as np

from lakemill.llm import quality_classifier as qc
from lakemill.llm.catalogue import queries

SF = "/root/testdata/sf0.01"


def plain_score(model: dict, x: list[float]) -> float:
    """One row, one table entry after the other."""
    total = model["start"]
    for f, table in enumerate(model["tables"]):
        total += table[bisect_right(model["cuts"][f].tolist(), x[f])]
    for f, e, table in model["pairs"]:
        total += table[bisect_right(model["coarse"][f].tolist(), x[f])][bisect_right(model["coarse"][e].tolist(), x[e])]
    return 1 / (1 + math.exp(-total))


def area(scores: list[float], labels: list[int]) -> float:
    """Share of pairs of a good and a bad row in which the good one has the higher score."""
    good = [s for s, y in zip(scores, labels) if y]
    bad = [s for s, y in zip(scores, labels) if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_every_row_has_the_score_of_the_tables_and_held_out_rows_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    folded = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows, kinds = {r["doc_id"]: r["text"] for r in docs.collect()}, qc.character_kinds()
    x = {i: qc.features(t, kinds) for i, t in rows.items()}
    learned = sorted(i for i, y in labels.items() if y is not None and i in x and not folded(i))
    model = qc.fit(np.array([x[i] for i in learned]), np.array([labels[i] for i in learned], float))
    got = {r["doc_id"]: r for r in queries()["op5_quality_classifier"](spark, SF).collect()}
    assert set(got) == set(rows)
    for i, r in got.items():
        assert r["held_out"] == folded(i) and r["predicted"] == int(r["score"] >= 0.3)
        assert abs(r["score"] - plain_score(model, x[i])) < 1e-9
    held = [i for i, y in labels.items() if y is not None and i in got and folded(i)]
    assert area([got[i]["score"] for i in held], [labels[i] for i in held]) >= 0.95
    again = {r["doc_id"]: r["score"] for r in queries()["op5_quality_classifier"](spark, SF).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_clashing_columns_and_an_empty_table(spark, docs, tables):
    folder = tables(documents=docs(["a b", "c d e"]).withColumnRenamed("lang", "features").withColumnRenamed("source", "score"), labels=spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int"))
    assert queries()["op5_quality_classifier"](spark, folder).count() == 2
    assert queries()["op5_quality_classifier"](spark, tables(documents=docs([]))).count() == 0

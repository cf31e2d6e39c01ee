"""Vector search with repeated ids, odd lengths and null ids, and its memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lakemill.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def points(n, seed=3):
    return [[float(x) for x in v] for v in np.random.default_rng(seed).normal(size=(n, 4))]


def found(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return vector_search.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank", "vec_id").collect()


def test_each_row_with_a_repeated_id_has_five_neighbours_and_sees_the_other(spark):
    v = points(30)
    got = found(spark, [(0, v[0]), (0, v[0]), *[(i, v[i]) for i in range(1, 30)]])
    ranks = [r["rank"] for r in got]
    assert ranks == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [r["vec_id"] for r in got if r["rank"] == 1] == [0, 0]
    assert len({r["vec_id"] for r in got}) == 5


def test_the_most_frequent_length_counts(spark):
    v = points(30)
    rows = [(i, v[i]) for i in range(30)]
    df = spark.createDataFrame([(i,) for i in range(1000, 1400)], "i long")
    known = spark.range(30).agg(F.min(F.xxhash64("id"))).first()[0]
    odd = df.filter(F.xxhash64("i") < known).first()
    #: This id stands before all others by its hash.
    assert odd is not None
    got = found(spark, [(odd["i"], [1.0, 2.0]), *rows])
    assert [r["rank"] for r in got if r["query_id"] == 0] == [1, 2, 3, 4, 5]


def test_vectors_of_another_length_find_each_other(spark):
    v = points(30)
    got = found(spark, [*[(i, v[i]) for i in range(1, 31 - 1)], (50, [1.0, 0.0]), (51, [1.0, 1.0]), (52, [0.0, 1.0]), (100, [3.0])])
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(50, 1, 51), (50, 2, 52)]


def test_very_large_and_very_small_components_have_scores(spark):
    rows = [(0, [1e200, 1e200], 0), (1, [1e-200, 1e-200], 0), (2, [1.0, 0.0], 0), (3, [-1e300, 0.0], 0), (4, [2.0**-1070, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_search.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 4, 3]
    assert np.allclose([r["score"] for r in got], [1, 0.5**0.5, 0.5**0.5, -(0.5**0.5)], atol=1e-12)


def test_rows_without_an_id_take_no_part(spark):
    v = points(30)
    got = found(spark, [*[(i, v[i]) for i in range(30)], (None, v[0])])
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(r["vec_id"] is not None for r in got)


def test_queries_of_a_leaf_are_cut_into_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(points(1500))], SCHEMA)
    seen, real = [], vector_search.cells
    monkeypatch.setattr(vector_search, "cells", lambda *a: seen.append(real(*a)) or seen[-1])
    whole = vector_search.search(df, F.lit(True)).collect()
    monkeypatch.setattr(vector_search, "BLOCK", 100)
    monkeypatch.setattr(vector_search, "PART", 40)
    cut = vector_search.search(df, F.lit(True)).collect()
    largest = lambda side, *by: max(r["count"] for r in side.groupBy(*by).count().collect())
    assert largest(seen[0][0], "leaf", "part", "block") > 200
    assert largest(seen[1][0], "leaf", "part", "block") < 170 and largest(seen[1][1], "in_leaf", "in_part", "in_block") < 80
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(cut) == 7500

"""Counts of crossing ranks against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.operators.ranking import crossings, inversion_counts


@pytest.mark.parametrize("n,most", [(0, 5), (1, 5), (2, 1), (50, 3), (257, 10**6)])
def test_crossings_within_one_part(n, most):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, most, n), rng.integers(-most, most, n)
    assert crossings(x, y).tolist() == [int(((x > x[i]) & (y < y[i])).sum()) for i in range(n)]


@pytest.mark.parametrize("kind", ["apart", "ties", "one hot value", "equal"])
def test_counts_equal_all_pairs(spark, kind):
    rng = random.Random(kind)
    value = {"apart": lambda: rng.randint(-10**12, 10**12), "ties": lambda: rng.randint(0, 9), "one hot value": lambda: rng.choice([5, 5, rng.randint(0, 10**6)]), "equal": lambda: 3}[kind]
    rows = [(i, value(), value()) for i in rng.sample(range(10**6), 700)]
    df = spark.createDataFrame(rows, "id long, units long, sales long")
    got = {r["id"]: r["overtaken_by"] for r in inversion_counts(df, "id", F.col("units"), F.col("sales"), cuts=8).collect()}
    u, s = (np.array([r[k] for r in rows]) for k in (1, 2))
    assert got == {r[0]: int(((u < r[1]) & (s > r[2])).sum()) for r in rows}


def test_no_entities(spark):
    df = spark.createDataFrame([], "id long, units long, sales long")
    assert inversion_counts(df, "id", F.col("units"), F.col("sales")).count() == 0

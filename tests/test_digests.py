"""Differences by range digests against set_diff, and what they move."""

from __future__ import annotations

import random

import pytest

from lakemill.operators import digests
from lakemill.operators.quality import set_diff

LEAF = 32_768


def keys(spark, values):
    return spark.createDataFrame([(v, "x") for v in values], "id long, other string")


def shown(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_difference_of_sets(spark, monkeypatch, seed):
    monkeypatch.setattr(digests, "FAN", 2)
    rng = random.Random(seed)
    base = [rng.randint(-3 * LEAF, 60 * LEAF) for _ in range(3000)]
    left, right = base + rng.choices(base, k=500), [v for v in base if rng.random() > 0.002] + [rng.randint(0, 90 * LEAF) for _ in range(4)]
    a, b = keys(spark, left), keys(spark, right)
    assert shown(digests.range_diff(a, b, "id")) == shown(set_diff(a.select("id"), b.select("id"), "id"))


def test_ranges_that_agree_move_no_keys(spark, monkeypatch):
    left = [i * 97 for i in range(40_000)]
    moved, real = [], digests.set_diff
    monkeypatch.setattr(digests, "set_diff", lambda a, b, key: moved.append((a.count(), b.count())) or real(a, b, key))
    gone = left[20_000]
    assert shown(digests.range_diff(keys(spark, left), keys(spark, [v for v in left if v != gone]), "id")) == [(gone, "left")]
    here = sum((v - 1) // LEAF == (gone - 1) // LEAF for v in left)
    assert moved == [(here, here - 1)] and here < 400
    assert shown(digests.range_diff(keys(spark, left), keys(spark, left[::-1]), "id")) == []
    assert moved[1] == (0, 0)


def test_empty_sides(spark):
    none, some = keys(spark, []), keys(spark, [1, 2, 2])
    assert shown(digests.range_diff(none, none, "id")) == []
    assert shown(digests.range_diff(some, none, "id")) == [(1, "left"), (2, "left")]
    assert shown(digests.range_diff(none, some, "id")) == [(1, "right"), (2, "right")]

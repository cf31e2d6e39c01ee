"""Whitening against a dense eigendecomposition, and rows that have no place in it."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lakemill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, id string"


def brute(rows, components=4):
    """(id, component) -> (n, deviation, |whitened|, explained) from the whole covariance."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in usable]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, x in xs:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(components, len(values))):
            white = float((np.array(x) - mean) @ vectors[:, -1 - k] / math.sqrt(values[-1 - k]))
            out.append((i, k + 1, n, deviation, abs(white), float(values[-1 - k] / values.sum())))
    return sorted(out, key=lambda r: (r[0] is None, r[:2], r[4]))


def found(spark, rows):
    return whitening.whiten(spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)).collect()


def compare(got, want):
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=lambda r: (r[0] is None, r[:2], r[4]))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-8, atol=1e-9)


def cloud(n, width, seed=5):
    rng = np.random.default_rng(seed)
    spread = 1 / (1 + np.arange(width)) ** 0.3
    return [[float(c) for c in v] for v in rng.normal(size=(n, width)) * spread + rng.normal(size=width)]


def test_wide_vectors_go_through_the_filter(spark):
    rows = list(enumerate(cloud(300, 40)))
    rows += [(7, rows[7][1]), (None, rows[8][1]), (500, None), (501, [float("nan")] * 40), (502, [None] + [1.0] * 39), (503, [1.0, 2.0])]
    got = found(spark, rows)
    compare(got, brute([r for r in rows if r[0] != 503]))
    assert max(r["identity_error"] for r in got) < 1e-9


def test_filter_finds_close_eigenvalues():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    spectrum = np.r_[10.0, 5.0, 5.0 - 1e-3, 4.9, np.linspace(4.85, 0.0, 196)]
    matrix = (turn * spectrum) @ turn.T
    passes = []
    values, vectors = whitening.leading(lambda q: passes.append(1) or matrix @ q, 200, 4)
    assert np.allclose(values, spectrum[:4], rtol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * values) < 1e-11
    assert len(passes) < 200


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_varies(spark, rows):
    assert found(spark, rows) == []


def test_narrow_and_flat_vectors(spark):
    rows = [(0, [0.0, 0.0, 5.0]), (1, [1.0, 0.0, 5.0]), (2, [2.0, 1.0, 5.0]), (3, [3.0, 5.0, 5.0])]
    got = found(spark, rows)
    assert {r["component"] for r in got} == {1, 2}
    compare(got, [w for w in brute(rows, 2)])


def test_very_large_components_do_not_crash(spark):
    got = found(spark, [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [1.0, 3.0])])
    assert {r["vec_id"] for r in got} == {0, 1, 2}
    assert all(r["deviation"] is None for r in got if r["vec_id"] < 2)


def test_given_table(spark):
    df = whitening.op11_whitening(spark, "/root/testdata/sf0.001")
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    compare(df.collect(), brute(rows))

"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, x = floor(256 * c). The fit list, each different x once, is written as packed blocks;
a pass over it is one Spark job in which every task centres its vectors, multiplies them with a narrow matrix Q and
back, and adds up X'(X Q). No pass forms the covariance, and what reaches the driver is one narrow matrix.

A round is a Rayleigh-Ritz step on a block of the wanted directions and some guards, then a Chebyshev polynomial of
the covariance applied by its recurrence, one pass for each degree. The polynomial is small on [0, cut], the unwanted
spectrum, and grows fast above; cut is the smallest Ritz value of the block. A QR step follows. Each round puts fresh
random directions in the place of the last guards, so that no direction can stay hidden. The rounds end when the
wanted pairs are certified: their residuals |V q - e q| are at the rounding level of a pass, or far under the
tolerance and no longer falling. One more pass measures the covariance of the whitened fit list.

Defined results: rows whose vector is null or holds a null or a component that is not finite are left out, as are
vectors of another length than the most frequent one (of equally frequent ones the shortest). Repeated rows and ids
count once in the fit list when their x are equal, and each row has its own results. A component whose variance is zero
within rounding has no direction of its own and is not returned, so a table with one different vector, with empty
vectors or without rows has no result rows. x is held within the range of a long; a deviation beyond it is null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.lineage import shared_folder
from lakemill.sources.tables import read_table

COMPONENTS = 4
#: Guards beside the wanted directions; the last FRESH of them are drawn anew in each round.
GUARDS, FRESH = 18, 2
DEGREE = 12
ROUNDS = 60
#: A residual, as a share of the largest eigenvalue, that counts as found once it no longer falls.
TOLERANCE = 1e-10
#: Vectors in a packed block.
BLOCK = 1024

Product = Callable[[np.ndarray], np.ndarray]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(vector: Column) -> Column:
    """x of a vector; the conversion to long keeps within its range."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(256.0)))


def rows_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)


def packed(vectors: DataFrame, width: int) -> DataFrame:
    """Rows of BLOCK vectors at most, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch, width)
            yield pa.record_batch({"block": pa.array([x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)], pa.binary())})

    return vectors.select("x").mapInArrow(pack, "block binary")


def summed(blocks: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (a matrix of doubles) over all blocks of whole numbers, added up in the tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column("block"):
                one = part(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, width))
                total = one if total is None else total + one
        if total is not None:
            flat = total.ravel()
            yield pa.record_batch({"at": pa.array(np.arange(len(flat))), "value": pa.array(flat, pa.float64())})

    rows = blocks.mapInArrow(add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def exact_sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each component, as whole numbers of any size: 32 bits at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, width)
                low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
                yield pa.record_batch({"at": pa.array(np.arange(width)), "low": pa.array(low), "high": pa.array(high), "n": pa.array(np.full(width, len(x)))})

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = blocks.mapInArrow(add, "at long, low long, high long, n long").groupBy("at").agg(wide("low"), wide("high"), F.sum("n").alias("n")).collect()
    sums = {r["at"]: int(r["low"]) + (int(r["high"]) << 32) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums.get(i, 0) for i in range(width)]


def filtered(product: Product, block: np.ndarray, image: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times ``block``: small on [0, cut], one at ``top``. ``image`` is V times the block."""
    half = cut / 2
    first = scale = half / (top - half)
    before, now = block, (image - half * block) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, 2 * following / half * (product(now) - half * now) - scale * following * before
        scale = following
    return now


def ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values from the largest on, their vectors, and V times these."""
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, image @ turn


def leading(product: Product, width: int, wanted: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of V and their vectors, certified by their residuals."""
    rng = np.random.default_rng(seed)
    size = min(width, wanted + GUARDS)
    block = np.linalg.qr(rng.standard_normal((width, size)))[0] if size < width else np.eye(width)
    last = np.inf
    for _ in range(ROUNDS):
        values, block, image = ritz(block, product(block))
        residual = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max(initial=0.0)
        top = values[0]
        if size == width or top <= 0 or residual <= 4 * np.finfo(float).eps * top:
            return values[:wanted], block[:, :wanted]
        if residual <= TOLERANCE * top and residual > last / 2:
            return values[:wanted], block[:, :wanted]
        last = residual
        cut = max(values[-1 - FRESH], values[0] * 1e-12)
        block = np.linalg.qr(filtered(product, block, image, cut, top, DEGREE) if cut < top else image)[0]
        block[:, -FRESH:] = rng.standard_normal((width, FRESH))
        block = np.linalg.qr(block)[0]
    raise ArithmeticError(f"no certified directions after {ROUNDS} rounds")


@dataclass
class Whitening:
    """What a fit has found: sums, directions divided by the root of their variance, and shares of the whole variance."""

    width: int
    n: int
    sums: list[int]
    mean: np.ndarray
    directions: np.ndarray
    explained: list[float]
    identity_error: float

    @classmethod
    def fit(cls, blocks: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
        n, sums = exact_sums(blocks, width) if width else (0, [])
        if not n:
            return cls(width, 0, sums, np.zeros(width), np.zeros((width, 0)), [], 0.0)
        mean = np.array([float(Fraction(s, n)) for s in sums])

        def product(q: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> np.ndarray:
                centred = x - mean
                return centred.T @ (centred @ q)

            return summed(blocks, width, part).reshape(q.shape) / n

        trace = summed(blocks, width, lambda x: np.square(x - mean).sum(axis=0)).sum() / n
        values, vectors = leading(product, width, min(components, width))
        real = values > 64 * width * np.finfo(float).eps * trace
        directions = vectors[:, real] / np.sqrt(values[real])
        k = directions.shape[1]

        def moments(x: np.ndarray) -> np.ndarray:
            white = (x - mean) @ directions
            return np.vstack([white.T @ white, white.sum(axis=0)])

        error = 0.0
        if k:
            found = summed(blocks, width, moments).reshape(k + 1, k) / n
            error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
        return cls(width, n, sums, mean, directions, [float(v / trace) for v in values[real]], error)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The exact sum of (n * x - S)^2 of each row; null beyond the range of a long."""
        rough = np.square(self.n * (x - self.mean)).sum(axis=1)
        if rough.max(initial=0) < 2**61 and np.abs(x).max(initial=0) * float(self.n) < 2**61:
            off = x * self.n - np.array([int(s) for s in self.sums], np.int64)
            return pa.array(np.square(off).sum(axis=1), pa.int64())
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, x) as (id, component, deviation, whitened)."""
        width, k = self.width, self.directions.shape[1]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = rows_of(batch, width)
                white = (x - self.mean) @ self.directions
                every = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.record_batch(
                    {
                        "id": batch.column("id").take(every),
                        "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        "deviation": self.deviations(x).take(every),
                        "whitened": pa.array(white.ravel(), pa.float64()),
                    }
                )

        return rows.mapInArrow(project, f"id {rows.schema['id'].dataType.simpleString()}, component int, deviation long, whitened double")


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    spark = table.sparkSession
    rows = table.filter(usable(F.col(vector))).select(F.col(key).alias("id"), whole(F.col(vector)).alias("x"))
    common = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width = common["width"] if common else 0
    rows = rows.filter(F.size("x") == width)
    path = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    packed(rows.select("x").distinct(), width).write.parquet(path)
    fit = Whitening.fit(spark.read.parquet(path), width, components)
    share = F.element_at(F.array(*[F.lit(e) for e in fit.explained] or [F.lit(0.0)]), F.col("component"))
    return fit.apply(rows).select(
        F.col("id").alias(key), "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(fit.identity_error).alias("identity_error")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))

"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample of the vectors; every vector is then indexed under its leaf. A
query walks the tree with a priority queue of branches, nearest first, and so lists leaves in the order in
which it would visit them. How many it visits is calibrated: on sample queries the visits widen until the
exact neighbours among the sample are found with the recall aimed at. Queries meet the vectors of the
leaves that they visit through a join on the leaf; a leaf with many vectors is cut into parts by a hash, and
its queries into blocks. Each block meets each part on its own, so that the memory of a comparison does not
follow the table; it keeps the best of each query, so what goes on is bounded by visits, not by the size of
a leaf.

Scores are cosines in double precision, each computed row by row from the original vectors, so equal
vectors have equal scores. Ties go to the smaller id.

Defined results: rows with a null id and vectors that are null, zero, or hold a null or non-finite component
take no part, neither as query nor as candidate. Vectors of different lengths are no neighbours: the tree is for
the most frequent length (the smaller of two that are equally frequent), and vectors of another length are
compared with all of their length, without a tree. A query without candidates has no row. Rows with one id are
separate candidates and separate queries: each has its own ranks, and sees the others but not itself. Vectors
are scaled by a power of two first, which changes no bit of a score but lets very large and very small
components neither overflow nor vanish.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.lineage import settle
from lakemill.sources.tables import read_table

NEAREST = 5
#: Vectors on which the tree is fitted, of which so many are sample queries.
SAMPLE = 20_000
SAMPLE_QUERIES = 200
BRANCHES = 8
LEAF = 64
RECALL = 0.98
#: Vectors in one part of a leaf, and queries in one block of those that visit it.
PART = 4096
BLOCK = 2048


def normed(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of at most k groups of unit vectors; fewer where points repeat."""
    centres = np.unique(points[rng.choice(len(points), min(k, len(points)), replace=False)], axis=0)
    for _ in range(rounds):
        at = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        norms = np.linalg.norm(sums, axis=1)
        centres = sums[norms > 1e-12] / norms[norms > 1e-12, None]
    return centres


class Tree:
    """Centres of each inner node and the nodes under them; leaves are numbered."""

    def __init__(self, centres: list[np.ndarray], children: list[list[int]], leaves: int) -> None:
        self.centres, self.children, self.leaves = centres, children, leaves

    @classmethod
    def fit(cls, points: np.ndarray, seed: int = 0) -> Tree:
        tree = cls([], [], 0)
        tree._grow(points, np.random.default_rng(seed))
        return tree

    def _grow(self, points: np.ndarray, rng: np.random.Generator) -> int:
        """The node's number; a leaf is -1 - its number among the leaves."""
        if len(points) > LEAF:
            centres = k_means(points, BRANCHES, rng)
            at = (points @ centres.T).argmax(axis=1)
            if len(np.unique(at)) > 1:
                node = len(self.centres)
                self.centres.append(centres)
                self.children.append([])
                for c in range(len(centres)):
                    self.children[node].append(self._grow(points[at == c], rng))
                return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0 if self.centres else -1, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                at = (points[rows] @ self.centres[node].T).argmax(axis=1)
                todo += [(child, rows[at == c]) for c, child in enumerate(self.children[node])]
        return out

    def visits(self, point: np.ndarray, most: int) -> list[int]:
        """The first leaves of a best-bin-first walk: always on from the nearest open branch."""
        if not self.centres:
            return [0]
        out, queue = [], [(0.0, 0)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while node >= 0:
                far = 1.0 - self.centres[node] @ point
                order = np.argsort(far, kind="stable")
                for c in order[1:]:
                    heapq.heappush(queue, (float(far[c]), self.children[node][c]))
                node = self.children[node][order[0]]
            out.append(-1 - node)
        return out


def calibrated_visits(tree: Tree, points: np.ndarray, recall: float = RECALL) -> int:
    """Leaves that a query must visit so that its exact neighbours in the sample are found."""
    if tree.leaves <= 1:
        return 1
    leaf = tree.leaf_of(points)
    step = max(1, len(points) // SAMPLE_QUERIES)
    needed = []
    for q in range(0, len(points), step):
        close = points @ points[q]
        close[q] = -2
        best = np.argpartition(-close, min(NEAREST, len(close) - 1))[:NEAREST]
        place = {x: i for i, x in enumerate(tree.visits(points[q], tree.leaves))}
        needed += [place[x] + 1 for x in leaf[best]]
    return int(np.quantile(needed, recall, method="higher"))


def usable(vector: str) -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, so that the largest component of each is between a half and one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]) if vectors.size else vectors


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return scaled(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1))


def best_in_part(queries: pa.Table, part: pa.Table, k: int) -> pa.Table:
    """The k best of one part of a leaf for each of its queries."""
    out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and part.num_rows:
        ids, rows, vectors = part.column("stored_id").to_numpy(), part.column("stored_row").to_numpy(), matrix(part.column("stored"))
        asked, own, wanted = queries.column("id").to_numpy(), queries.column("row").to_numpy(), matrix(queries.column("vector"))
        rough = normed(wanted) @ normed(vectors).T
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        for i, q in enumerate(asked):
            rough[i, rows == own[i]] = -2
            line = rough[i]
            cut = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -1.5
            near = np.flatnonzero((line >= cut - 1e-9) & (line > -1.5))
            exact = (vectors[near] * wanted[i]).sum(axis=1) / (lengths[near] * np.sqrt((wanted[i] * wanted[i]).sum()))
            for j in np.lexsort((ids[near], -exact))[:k]:
                out["query_row"].append(int(own[i]))
                out["query_id"].append(int(q))
                out["vec_id"].append(int(ids[near[j]]))
                out["score"].append(float(exact[j]))
    return pa.table({"query_row": pa.array(out["query_row"], pa.int64()), "query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def cells(indexed: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries by (leaf, part, block) and stored vectors by (in_leaf, in_part, in_block), at most about BLOCK and PART of them in each."""
    asked = asked.withColumn("leaf", F.explode("leaves"))
    count = lambda df, size, name: df.groupBy(F.col("leaf").alias("at")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    #: A row for each leaf, and the tree has at most SAMPLE leaves.
    cut = F.broadcast(count(indexed, PART, "parts").join(count(asked, BLOCK, "blocks"), "at"))
    pick = lambda name, of: F.pmod(F.xxhash64("row", F.lit(name)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asked.join(cut, F.col("leaf") == F.col("at")).withColumn("block", pick("block", "blocks")).withColumn("part", every("parts"))
    right = indexed.join(cut, F.col("leaf") == F.col("at")).withColumn("in_part", pick("part", "parts")).withColumn("in_block", every("blocks"))
    stored = [F.col("id").alias("stored_id"), F.col("row").alias("stored_row"), F.col("vector").alias("stored"), F.col("leaf").alias("in_leaf")]
    return left.select("id", "row", "vector", "leaf", "part", "block"), right.select(*stored, "in_part", "in_block")


def search(table: DataFrame, queries: F.Column, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``table`` that ``queries`` picks."""
    spark = table.sparkSession
    rows = table.filter(usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null")
    common = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width = common["width"] if common else 1
    #: The numbers tell apart rows with one id; they are settled, so that a row keeps its own.
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    usual, others = rows.filter(F.size("vector") == width), rows.filter(F.size("vector") != width)
    sample = usual.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    points = normed(scaled(np.array([r["vector"] for r in sample]))) if sample else np.zeros((0, width))
    tree = Tree.fit(points)
    most = calibrated_visits(tree, points, recall) if len(points) > k else tree.leaves or 1
    shared = spark.sparkContext.broadcast((tree.centres, tree.children, tree.leaves))

    @F.arrow_udf(T.IntegerType())
    def leaf(column: pa.Array) -> pa.Array:
        return pa.array(Tree(*shared.value).leaf_of(normed(matrix(column))) if len(column) else [], pa.int32())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def visits(column: pa.Array) -> pa.Array:
        walk = Tree(*shared.value).visits
        return pa.array([walk(p, most) for p in normed(matrix(column))] if len(column) else [], pa.list_(pa.int32()))

    #: Vectors of another length have a leaf of their own for each length.
    apart = -F.size("vector")
    indexed = settle(usual.withColumn("leaf", leaf.asNondeterministic()(F.col("vector"))).unionByName(others.withColumn("leaf", apart)))
    ask = lambda df, leaves: df.withColumnRenamed("id", key).filter(queries).select(F.col(key).alias("id"), "row", "vector", leaves.alias("leaves"))
    asked = ask(usual, visits.asNondeterministic()(F.col("vector"))).unionByName(ask(others, F.array(apart)))
    left, right = cells(indexed, settle(asked))
    found = left.groupBy("leaf", "part", "block").cogroup(right.groupBy("in_leaf", "in_part", "in_block")).applyInArrow(lambda a, b: best_in_part(a, b, k), "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)

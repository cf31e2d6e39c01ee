"""N-gram Jaccard join with Bayesian pruning of candidates.

Equal texts are one class from the start. Each class has a MinHash sketch of its five-word shingles.
Classes that share a band of their sketches are candidates; sharing is kept as a star to the smallest
class of the band, never as pairs, and the connected stars are candidate groups.

Sketches go first. A group is cut into tiles, and a task gets the sketches of two tiles, without texts. A pair
that shares no band is no candidate. The sketches of the others are compared a few values at a time: a pair
whose posterior probability of reaching the threshold (uniform prior on the similarity) is below the
tolerance is dropped. What survives connects far smaller groups, and only their texts are moved.

Texts go second, in tiles bounded by number and bytes. The survivors between two tiles are verified exactly
from their whole texts: the sizes of the common shingle sets of many pairs come from one product of
incidence matrices. A task returns one row for each linked class, with its number of links and its place in a
spanning tree, so no pair leaves a task.

A pair of similarity s shares no band with probability (1 - s**4)**32, 5e-8 at 0.8, and is dropped by
the posterior with probability about the tolerance.

Defined results: words lie between ASCII white space and are compared as they are. A text of one to four
words is one shingle; a null or empty text has none and no links, but equal texts are one class. Repeated
rows are copies. Without any row there is no result row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.lineage import settle
from lakemill.llm.batches import steps, whole_numbers
from lakemill.llm.components import components
from lakemill.llm.hashing import odd_numbers, run_hashes
from lakemill.sources.tables import read_table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
TOLERANCE = 1e-9
#: Sketch values compared at a time.
STEP = 16
#: Parts into which a large group is split where its members are joined to the size of the group.
SALTS = 16
#: Classes in a tile of sketches, and classes and bytes of text in a tile of texts.
SKETCH_TILE = 256
TILE = 256
TILE_BYTES = 4_000_000
#: Shingles of one product of incidence matrices.
COLUMNS = 2048


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, text_of, counts = run_hashes(texts, SHINGLE)
    ends = np.cumsum(np.bincount(text_of, minlength=len(texts))) if len(texts) else []
    out = [np.unique(hashes[a:b]) for a, b in zip(np.r_[0, ends[:-1]].astype(int), ends)] if len(texts) else []
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        out[i] = run_hashes([texts[i]], int(counts[i]), seed=11)[0]
    return out


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, one for each of BANDS * ROWS hash functions."""
    factors, addends = odd_numbers(BANDS * ROWS, 3), odd_numbers(BANDS * ROWS, 5)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingle_set), 2048):
        part = shingle_set[at : at + 2048, None] * factors + addends
        least = np.minimum(least, (part >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return least


@F.arrow_udf(T.BinaryType())
def sketches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in steps(columns):
        yield pa.array([sketch(s).tobytes() if len(s) else None for s in shingles(texts.to_pylist())], pa.binary())


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of n that leave a posterior of at least the tolerance.

    With a uniform prior, the posterior after m of n is Beta(m + 1, n - m + 1), and its mass above the
    threshold is a binomial sum.
    """
    mass = 0.0
    for m in range(n + 1):
        mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if mass >= tolerance:
            return m
    return n


def sharing_a_band(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs (as a matrix) with a band in which all values are equal."""
    out = np.zeros((len(left), len(right)), bool)
    for band in range(0, BANDS * ROWS, ROWS):
        #: A number for each content of the band; it is the same on both sides.
        both = np.concatenate([left[:, band : band + ROWS], right[:, band : band + ROWS]])
        number = np.unique(np.ascontiguousarray(both).view(np.dtype((np.void, 4 * ROWS))).ravel(), return_inverse=True)[1].astype(np.int32)
        x, y = number[: len(left)], number[len(left) :]
        rows, columns = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
        out[np.ix_(rows, columns)] |= x[rows, None] == y[None, columns]
    return out


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Pairs (as a matrix) that share a band and that no look at the first values of the sketches has ruled out."""
    out = np.zeros((len(left), len(right)), bool)
    alive = sharing_a_band(left, right)
    rows, columns, equal = np.arange(len(left)), np.arange(len(right)), np.zeros(alive.shape, np.int16)
    for at in range(0, left.shape[1], STEP):
        #: Classes whose pairs are all ruled out leave the matrix.
        r, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(r):
            return out
        rows, columns, alive, equal = rows[r], columns[c], alive[np.ix_(r, c)], equal[np.ix_(r, c)]
        for k in range(at, at + STEP):
            equal += left[rows, k][:, None] == right[columns, k][None, :]
        alive &= equal >= least_matches(at + STEP, threshold, tolerance)
    out[np.ix_(rows, columns)] = alive
    return out


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common sets of all pairs, by products of incidence matrices over the shared shingles."""
    sides = []
    for side in (left, right):
        flat = np.concatenate(side)
        by = np.argsort(flat, kind="stable")
        sides.append((flat[by], np.repeat(np.arange(len(side)), [len(x) for x in side])[by]))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        incidence = []
        for (flat, row), side in zip(sides, (left, right)):
            inside = slice(np.searchsorted(flat, part[0]), np.searchsorted(flat, part[-1], side="right"))
            place = np.searchsorted(part, flat[inside])
            there = part[place] == flat[inside]
            matrix = np.zeros((len(side), len(part)), np.float32)
            matrix[row[inside][there], place[there]] = 1
            incidence.append(matrix)
        out += incidence[0] @ incidence[1].T
    return out.astype(np.int64)


def links(left: list[np.ndarray], right: list[np.ndarray], kept: np.ndarray, threshold: float) -> np.ndarray:
    """The kept pairs whose exact similarity reaches the threshold."""
    ratio = Fraction(str(threshold))
    out = np.zeros(kept.shape, bool)
    rows, columns = np.flatnonzero(kept.any(axis=1)), np.flatnonzero(kept.any(axis=0))
    if len(rows):
        both = common([left[i] for i in rows], [right[i] for i in columns])
        sizes = np.array([len(left[i]) for i in rows])[:, None] + np.array([len(right[i]) for i in columns])[None, :]
        out[np.ix_(rows, columns)] = both * ratio.denominator >= ratio.numerator * (sizes - both)
    return out & kept


def trees(linked: np.ndarray) -> np.ndarray:
    """For each node of an undirected graph (a matrix) the root of its tree, the first node reached."""
    root = np.full(len(linked), -1)
    for node in range(len(linked)):
        if root[node] < 0:
            front = np.array([node])
            root[node] = node
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = node
    return root


LINKED = "node long, root long, links long"


def two_tiles(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of two tiles, their sketches as a matrix, and which rows are of the first tile and of the second.

    Rows come in any order, and roots depend on it; sorted, a task that runs again names the same roots.
    """
    rows = rows.sort_by("node")
    values = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
    tiles = rows.column("tile").to_numpy()
    return rows, values, np.flatnonzero(tiles == rows.column("a")[0].as_py()), np.flatnonzero(tiles == rows.column("b")[0].as_py())


def linked_rows(rows: pa.Table, left: np.ndarray, right: np.ndarray, between: np.ndarray) -> pa.Table:
    """(node, root, links) for each row with a link, from the links between two tiles."""
    linked = np.zeros((len(rows), len(rows)), bool)
    linked[np.ix_(left, right)] = between
    linked |= linked.T
    np.fill_diagonal(linked, False)
    count, nodes = linked.sum(axis=1), rows.column("node").to_numpy()
    some = np.flatnonzero(count)
    return pa.table({"node": pa.array(nodes[some], pa.int64()), "root": pa.array(nodes[trees(linked)[some]], pa.int64()), "links": pa.array(count[some].astype(np.int64))})


def prune(rows: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """One pair of tiles of sketches: the classes with a surviving pair, as a forest."""
    rows, values, left, right = two_tiles(rows)
    return linked_rows(rows, left, right, survivors(values[left], values[right], threshold, tolerance))


def compare(rows: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """One pair of tiles of texts: (node, root, links) for each class with a verified link between the two."""
    rows, values, left, right = two_tiles(rows)
    kept = survivors(values[left], values[right], threshold, tolerance)
    some = np.unique(np.r_[left[kept.any(axis=1)], right[kept.any(axis=0)]])
    sets = dict(zip(some.tolist(), shingles(rows.column("text").take(pa.array(some)).to_pylist())))
    none = np.zeros(0, np.uint64)
    between = links([sets.get(i, none) for i in left.tolist()], [sets.get(i, none) for i in right.tolist()], kept, threshold)
    return linked_rows(rows, left, right, between)


def node_of(text: Column) -> Column:
    """A number for each distinct text."""
    return F.xxhash64(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)))


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, label) for classes that share a band with another, directly or over others."""
    bands = F.array(*[F.xxhash64(F.substring("sketch", 4 * ROWS * b + 1, 4 * ROWS), F.lit(b)) for b in range(BANDS)])
    placed = classes.filter("sketch IS NOT NULL").select(F.col("node").alias("at"), F.explode(bands).alias("band"))
    heads = placed.groupBy("band").agg(F.min("at").alias("head"), F.max("at").alias("last")).filter("head <> last").select("band", "head")
    stars = placed.join(heads, "band").filter("at <> head").select(F.col("at").alias("a"), F.col("head").alias("b"))
    return components(stars)


def by_tiles(members: DataFrame, tiles: Column) -> DataFrame:
    """``members`` (node, label, ...) once for each pair of tiles of its group: with tile, a and b."""
    size = members.groupBy(F.col("label").alias("group")).agg(tiles.cast("int").alias("tiles")).filter("tiles > 0")
    size = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col("label") == F.col("group")) & (F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)) == F.col("salt"))
    placed = members.join(size, same).withColumn("tile", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")}).drop("tiles", "other", "label", "salt")


def verified_links(rows: DataFrame, classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, root, links) of each pair of tiles. ``rows`` has key, node and text."""
    known = classes.select(F.col("node").alias("n"), "rep", "sketch", "bytes")
    number = F.count(F.lit(1))
    sketched = candidate_groups(classes).join(known, F.col("node") == F.col("n")).select("node", "label", "sketch")
    forest = by_tiles(sketched, F.ceil(number / SKETCH_TILE)).groupBy("group", "a", "b").applyInArrow(lambda t: prune(t, threshold, tolerance), LINKED)
    groups = components(forest.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = settle(groups.join(known, F.col("node") == F.col("n")).select(F.col("node").alias("member"), "label", "rep", "sketch", "bytes"))
    #: Rows that repeat in key and text would stand twice for one class.
    texts = rows.join(members, (F.col("node") == F.col("member")) & F.col("key").eqNullSafe(F.col("rep"))).dropDuplicates(["node"])
    tiled = by_tiles(members.select(F.col("member").alias("node"), "label", "bytes"), F.greatest(F.ceil(number / TILE), F.ceil(F.sum("bytes") / TILE_BYTES)))
    places = tiled.select(F.col("node").alias("place"), "group", "tile", "a", "b")
    dealt = texts.select("node", "text", "sketch").join(places, F.col("node") == F.col("place")).drop("place")
    return dealt.groupBy("group", "a", "b").applyInArrow(lambda t: compare(t, threshold, tolerance), LINKED)


def text_classes(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """One row for each distinct text of ``rows`` (key, node, text): node, rep (its smallest key), copies, links, and
    the head of its class, the text with the class's smallest key (head_rep, head_node)."""
    sketched = rows.select("key", "node", F.octet_length("text").alias("bytes"), sketches.asNondeterministic()(F.col("text")).alias("sketch"))
    kept = [F.any_value(c).alias(c) for c in ("sketch", "bytes")]
    classes = settle(sketched.groupBy("node").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), *kept))
    found = settle(verified_links(rows, classes, threshold, tolerance))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "j")
    degrees = found.groupBy(F.col("node").alias("d")).agg(F.sum("links").alias("links"))
    known = classes.select("node", "rep", "copies").join(joined, F.col("node") == F.col("j"), "left").join(degrees, F.col("node") == F.col("d"), "left")
    known = settle(known.select("node", "rep", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    first = F.min(F.struct(F.col("rep").isNull(), F.col("rep").alias("rep"), F.col("node").alias("node")))
    heads = known.groupBy(F.col("label").alias("l")).agg(first.alias("head"))
    return known.join(heads, F.col("label") == F.col("l")).select("node", "rep", "copies", "links", F.col("head.rep").alias("head_rep"), F.col("head.node").alias("head_node"))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole_numbers(docs, key)
    return docs.select(F.col(key).cast("long").alias("key"), node_of(F.col(text)).alias("node"), F.col(text).alias("text"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of ``docs``: key, class_id (the smallest key of its class), n_links, n_copies.

    ``n_links`` counts other texts at the threshold or above, ``n_copies`` rows with the same text.
    """
    rows = keyed(docs, key, text)
    classes = text_classes(rows, threshold, tolerance).withColumnRenamed("node", "n")
    return rows.select("key", "node").join(classes, F.col("node") == F.col("n")).select(
        F.col("key").alias(key), F.col("head_rep").alias("class_id"), F.col("links").cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with one row for each class, the one with the smallest key; of equal rows one."""
    heads = text_classes(keyed(docs, key, text), threshold, tolerance).filter(F.col("node") == F.col("head_node")).select(F.col("node").alias("__n"), F.col("rep").alias("__rep"))
    numbered = docs.withColumns({"__node": node_of(F.col(text)), "__key": F.col(key).cast("long")})
    kept = numbered.join(heads, (F.col("__node") == F.col("__n")) & F.col("__key").eqNullSafe(F.col("__rep")), "left_semi")
    return kept.dropDuplicates(["__node", "__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
c AS (SELECT t, any_value(words) AS words, min(doc_id) AS rep, count(*) AS copies FROM w GROUP BY t),
s AS (
  SELECT DISTINCT rep, words[i:i + {SHINGLE - 1}] AS sh FROM c, LATERAL unnest(range(1, greatest(len(words) - {SHINGLE - 2}, least(len(words), 1) + 1))) u(i)
), n AS (SELECT rep, count(*) AS size FROM s GROUP BY rep),
o AS (SELECT a.rep AS x, b.rep AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.rep = x JOIN n b ON b.rep = y WHERE 10 * shared >= 8 * (a.size + b.size - shared)),
r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x AS rep, min(y) AS class_id FROM r GROUP BY x),
d AS (SELECT x AS rep, count(*) AS links FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(links, 0)::BIGINT AS n_links, copies AS n_copies
FROM w JOIN c USING (t) JOIN k USING (rep) LEFT JOIN d USING (rep)
"""

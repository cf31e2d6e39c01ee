"""Quality classifier: a generalised additive model with pairwise interactions.

Each whole text gives a few numbers. Boosting goes over the features in turn; each step fits a shallow tree
(two cuts) on one feature's binned gradients and adds it, scaled down, to that feature's lookup table. Then
the pairs of features that explain most of what is left get tables of their own, boosted in the same way. A
score is a sum of table entries, looked up for many texts at once, through the logistic function.

Training takes a sample of the labelled rows of at most TRAINED rows or so, chosen by a hash; scores cover
every row.

Defined results: a null or empty text has its own feature values (no words) and gets a score like any
other; without labels of both kinds the tables stay empty and all scores are the smoothed share of good
labels. Rows that repeat get equal scores. Labels, language, source and ids are no features.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.lineage import settle
from lakemill.sources.tables import read_table

TRAINED = 20_000
FOLDS = 5
CUT = 0.3
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 200, 60, 8
RATE = 0.1
SHRINK = 5.0
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "words", "word_length", "upper", "digit", "symbol", "mark", "shout", "bar", "line_words", "repeated_lines", "distinct", "top_word", "short", "long", "no_letter", "wide", "cut_word", "next_repeat",
)


def character_kinds() -> np.ndarray:
    """Kind of each UTF-16 unit: 0 other letter, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 symbol, 7 mark, 8 shout, 9 bar, 10 wide."""
    kinds = np.full(65536, 10, np.uint8)
    for i in range(0x2000):
        c = chr(i)
        kinds[i] = 2 if c.isupper() else 1 if c.islower() else 0 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 7
    kinds[ord("\n")], kinds[ord("!")] = 5, 8
    for c in SYMBOLS:
        kinds[ord(c)] = 6
    kinds[ord("|")] = 9
    return kinds


def features(text: str | None, kinds: np.ndarray) -> list[float]:
    """The numbers of one text, in the order of FEATURES."""
    text = text or ""
    n_kind = np.bincount(kinds[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)], minlength=11)
    chars = max(1, len(text))
    words = text.split()
    n = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:])))
    some = max(1, n)
    return [
        float(np.log1p(n)),
        float(lengths.mean()) if n else 0.0,
        n_kind[2] / chars,
        n_kind[3] / chars,
        n_kind[6] / chars,
        n_kind[7] / chars,
        n_kind[8] / chars,
        n_kind[9] / chars,
        float(np.log1p(n / max(1, len(lines)))),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        len(counts) / some**0.8,
        max(counts.values(), default=0) / some,
        float((lengths <= 3).sum() / some),
        float((lengths > 12).sum() / some),
        sum(map(str.isalpha, words)) / some,
        n_kind[10] / chars,
        float(lengths.max(initial=0)),
        1 - pairs / max(1, n - 1) if n > 1 else 0.0,
    ]


def with_features(docs: DataFrame, text: str = "text", into: str = "features") -> DataFrame:
    """``docs`` with the numbers of each text; no shuffle."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def numbers(column: pa.Array) -> pa.Array:
        kinds = character_kinds()
        return pa.array([features(x.as_py(), kinds) for x in column], pa.list_(pa.float64()))

    return docs.withColumn(into, numbers.asNondeterministic()(F.col(text)))


def bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), np.int64)


def shallow_tree(g: np.ndarray, h: np.ndarray, cuts: int = 2) -> np.ndarray:
    """Values of the bins after up to ``cuts`` cuts, each where the gain is largest."""
    parts = [(0, len(g))]
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + SHRINK)
    for _ in range(cuts):
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            sg, sh = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = sg**2 / (sh + SHRINK) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + SHRINK) - worth(a, b)
            if b - a > 1 and gain[:-1].max() > best[0]:
                best = (gain[:-1].max(), part, a + int(gain[:-1].argmax()) + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def square_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best four quarters of a pair's grid."""
    sg, sh = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    quarters = []
    for s in (sg, sh):
        low = s[:-1, :-1]
        quarters.append((low, s[:-1, -1:] - low, s[-1:, :-1] - low, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + low))
    gain = sum(a**2 / (b + SHRINK) for a, b in zip(*quarters))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for k, (rows, columns) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, columns] = quarters[0][k][i, j] / (quarters[1][k][i, j] + SHRINK)
    return float(gain.max()), out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The model: cuts and a table for each feature, coarse cuts and tables for some pairs, and a start."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    cuts, coarse = quantiles(BINS), quantiles(PAIR_BINS)
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = {"start": start, "cuts": cuts, "tables": tables, "coarse": coarse, "pairs": []}
    if not 0 < y.sum() < len(y):
        return model
    at, grid = bins_of(x, cuts), bins_of(x, coarse)
    score = np.full(len(y), start)
    for _ in range(ROUNDS):
        for f, table in enumerate(tables):
            p = 1 / (1 + np.exp(-score))
            tree = RATE * shallow_tree(np.bincount(at[:, f], y - p, len(table)), np.bincount(at[:, f], p * (1 - p), len(table)))
            table += tree
            score += tree[at[:, f]]

    def sums(f: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        shape = (len(coarse[f]) + 1, len(coarse[e]) + 1)
        cell = grid[:, f] * shape[1] + grid[:, e]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape), cell

    wide = [f for f, c in enumerate(coarse) if len(c)]
    ranked = sorted(((square_tree(*sums(f, e)[:2])[0], f, e) for f, e in itertools.combinations(wide, 2)), reverse=True)[:PAIRS]
    model["pairs"] = [(f, e, np.zeros((len(coarse[f]) + 1, len(coarse[e]) + 1))) for _, f, e in ranked]
    for _ in range(PAIR_ROUNDS):
        for f, e, table in model["pairs"]:
            g, h, cell = sums(f, e)
            tree = RATE * square_tree(g, h)[1]
            table += tree
            score += tree.ravel()[cell]
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row: table entries added up."""
    total = np.full(len(x), model["start"])
    at, grid = bins_of(x, model["cuts"]), bins_of(x, model["coarse"])
    for f, table in enumerate(model["tables"]):
        total += table[at[:, f]]
    for f, e, table in model["pairs"]:
        total += table[grid[:, f], grid[:, e]]
    return 1 / (1 + np.exp(-total))


def train(featured: DataFrame, labelled: DataFrame, key: str = "doc_id", label: str = "quality", most: int = TRAINED) -> dict:
    """Fit on at most ``most`` rows or so of ``labelled`` (key, label), joined to their features."""
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"))
    part = min(1.0, most / max(1, rows.count()))
    #: 12 bits of slack in a hash share: the sample stays near its bound, and the limit holds it there.
    chosen = rows.filter(F.pmod(F.xxhash64("k", F.lit("train")), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    sample = featured.join(chosen, F.col(key) == F.col("k")).select("k", "features", "label").limit(2 * most).collect()
    #: In one order, so that sums, and with them scores, are the same in every run.
    sample.sort(key=lambda r: (r["k"], r["label"], r["features"]))
    x = np.array([r["features"] for r in sample]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in sample], float))


def score(featured: DataFrame, model: dict, into: str = "score") -> DataFrame:
    @F.arrow_udf(T.DoubleType())
    def look_up(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return pa.array(scores(model, x) if len(x) else np.zeros(0), pa.float64())

    return featured.withColumn(into, look_up.asNondeterministic()(F.col("features")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(FOLDS)) == 0
    featured = settle(with_features(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    labelled = read_table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~fold("doc_id"))
    model = train(featured, labelled)
    return score(featured, model).select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

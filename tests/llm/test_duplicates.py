"""Substring dedup and the Jaccard join against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakemill.llm import jaccard_join, substring_dedup
from lakemill.llm.catalogue import oracle_sql, queries
from lakemill.llm.components import components, contracted
from tests.comparing import same

real = substring_dedup.window_hashes
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, alphabet=400):
    return [f"w{rng.randrange(alphabet)}" for _ in range(n)]


def stripped(rows):
    """(n_words, n_removed, checksum of the kept words) of each row, by the rule itself."""
    first: dict[tuple, int] = {}
    split = [(k, WORD.findall(t or "")) for k, t in rows]
    for k, w in split:
        if k is not None:
            for i in range(len(w) - 12):
                key = tuple(w[i : i + 13])
                first[key] = min(k, first.get(key, k))
    out = []
    for k, w in split:
        gone = {i + j for i in range(len(w) - 12) if k is not None and first[tuple(w[i : i + 13])] < k for j in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    passages = [words(rng, n) for n in (12, 13, 14, 60)]
    texts = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 30)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), p[rng.randint(0, 2) :])
        texts.append((i * 7 % 61, rng.choice([" ", "\n", "\t "]).join(x for p in parts for x in p)))
    return [*texts, (70, None), (71, ""), (72, "é" * 3), (73, texts[3][1]), (3, texts[4][1]), (3, texts[4][1]), (None, texts[5][1])]


def test_dedup_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 1500)
    rows = corpus(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocked, ranges = substring_dedup.in_blocks(df, "doc_id", "text")
    order = blocked.filter("doc_id is not null").select("doc_id", "__block").orderBy("doc_id").collect()
    assert ranges >= 32 and len({r[1] for r in order}) > 3 and [r[1] for r in order] == sorted(r[1] for r in order)
    got = substring_dedup.dedup(df).collect()
    assert sorted(((r["key"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str) == stripped(rows)
    check_factors(rows, got)


def check_factors(rows, got):
    """Each factor is one passage of one document with a smaller key, and together they are what goes."""
    texts: dict = {}
    for k, t in rows:
        texts.setdefault(k, []).append(WORD.findall(t or ""))
    for r in got:
        mine, gone = WORD.findall(r["text"] or ""), set()
        for f in r["factors"]:
            passage = mine[f["start"] : f["start"] + f["length"]]
            assert len(passage) == f["length"] >= 13 and f["key"] < r["key"]
            assert any(w[f["at"] : f["at"] + f["length"]] == passage for w in texts[f["key"]])
            gone |= set(range(f["start"], f["start"] + f["length"]))
        assert len(gone) == r["n_removed"]


def test_a_factor_is_one_occurrence(spark, monkeypatch):
    a = [f"a{i}" for i in range(17)]
    rows = [(k + 1, " ".join(a[k : k + 14])) for k in range(4)] + [(9, " ".join(a))]
    for size in (4_000_000, 60):
        monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", size)
        got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        check_factors(rows, got)
        last = next(r for r in got if r["key"] == 9)
        assert last["n_removed"] == 17 and len(last["factors"]) >= 2 and max(f["length"] for f in last["factors"]) == 14


def test_equal_hashes_of_other_words_make_no_factor(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda *a: (np.zeros_like(real(*a)[0]), *real(*a)[1:]))
    rows = [(i, " ".join(f"{'ab'[i % 2]}{j}" for j in range(20))) for i in range(2)]
    assert {r["n_removed"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_an_id_of_many_rows_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2000)
    rng = random.Random(6)
    passage = words(rng, 15)
    rows = [(5, " ".join(words(rng, 40) + passage)) for _ in range(60)] + [(k, " ".join(passage + words(rng, 30))) for k in (1, 5, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = {r["__block"] for r in substring_dedup.in_blocks(df, "doc_id", "text")[0].filter("doc_id = 5").collect()}
    assert len(blocks) > 3 and all(b & 1 for b in blocks)
    got = substring_dedup.dedup(df).collect()
    assert sorted(((r["key"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str) == stripped(rows)
    check_factors(rows, got)


def test_long_and_repetitive_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300_000)
    rng = random.Random(8)
    long = words(rng, 60_000, 5000)
    rows = [(1, " ".join(long)), (2, "the " * 30_000), (3, " ".join(long[100:50_000] + ["x"] + long[50_000:])), (4, "the " * 40), (5, "x" * 500_000)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["key"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got) == stripped(rows)


def test_a_key_that_is_no_number_is_refused(spark):
    df = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    for work in (substring_dedup.dedup, jaccard_join.near_duplicates, jaccard_join.one_of_each):
        with pytest.raises(TypeError):
            work(df)


def test_dedup_keeps_columns_and_untouched_texts(docs):
    passage = " ".join(words(random.Random(1), 20))
    df = docs([f"first\n{passage}", f"second {passage} end", passage, None]).withColumnRenamed("lang", "kept")
    out = substring_dedup.strip_repeats(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: f"first\n{passage}", 1: "second end", 3: None}
    assert substring_dedup.strip_repeats(docs([])).count() == 0


def test_dedup_query_equals_sql(spark):
    same(spark, queries()["op2_substring_dedup"], oracle_sql()["op2_substring_dedup"])


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    """Class, links and copies of each row by comparing all distinct texts."""
    texts = sorted({t or "" for _, t in rows})
    reps = {t: min(k for k, x in rows if (x or "") == t) for t in texts}
    sets = {t: shingle_set(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] and sets[u] and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u])] for t in texts}
    label = {}
    for t in texts:
        if t not in label:
            group, todo = {t}, [t]
            while todo:
                for u in links[todo.pop()]:
                    if u not in group:
                        group.add(u)
                        todo.append(u)
            for u in group:
                label[u] = min(reps[x] for x in group)
    return sorted((k, label[t or ""], len(links[t or ""]), sum((x or "") == (t or "") for _, x in rows)) for k, t in rows)


def near_rows(rng, n=120):
    rows, base = [], [words(rng, 80) for _ in range(4)]
    for i in range(n):
        w = list(base[i % 4]) if i % 3 else words(rng, rng.randint(1, 40))
        for _ in range(rng.randint(0, 3) if i % 3 else 0):
            w[rng.randrange(len(w))] = "x"
        rows.append((i, " ".join(w)))
    return [*rows, (200, None), (201, ""), (202, "a b"), (203, "a  b"), (204, rows[5][1]), (204, rows[5][1])]


def test_join_equals_brute_force_with_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "SKETCH_TILE", 12)
    rows = near_rows(random.Random(9))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute_classes(rows)


def test_one_of_each_class_stays(docs):
    text = " ".join(words(random.Random(3), 90))
    df = docs(["other words " + text[:60], text, text, text + " more", None, None]).withColumnRenamed("lang", "label")
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {0, 1, 4}
    assert jaccard_join.one_of_each(docs([])).count() == 0


def test_pruning_keeps_similar_pairs_and_drops_others():
    rng = np.random.default_rng(0)
    assert jaccard_join.least_matches(128, 0.8, 1e-9) < 90 and jaccard_join.least_matches(16, 0.8, 1e-9) < 8
    a = rng.integers(0, 2**32, (50, 128), dtype=np.uint64).astype(np.uint32)
    b = a.copy()
    flip = rng.random(b.shape) > 0.8
    b[flip] = 1
    alive = jaccard_join.survivors(a, b, 0.8, 1e-9)
    assert alive.diagonal().all() and alive.sum() == 50


def test_tiles_are_bounded_by_bytes_and_long_texts_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 200_000)
    rng = random.Random(11)
    long = words(rng, 30_000, 20_000)
    rows = [(i, " ".join([*long[:i], "y", *long[i:]])) for i in range(6)] + [(10, "z" * 300_000), (11, None), (None, "z z"), (None, "z z")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["class_id"], r["n_links"]) for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))[:6]] == [(0, 5)] * 6
    assert [(r["class_id"], r["n_copies"]) for r in got if r["doc_id"] is None] == [(None, 2)] * 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_join_query_equals_sql(spark):
    same(spark, queries()["op6_jaccard_join"], oracle_sql()["op6_jaccard_join"])


def test_components_evaluate_their_edges_once(spark):
    @F.arrow_udf("long")
    def other(column: pa.Array) -> pa.Array:
        return pa.array([1000 + uuid.uuid4().int % 2**60 for _ in column], pa.int64())

    edges = spark.range(50).select(F.col("id").alias("a"), other.asNondeterministic()("id").alias("b"))
    got = components(edges).collect()
    assert len({r.node for r in got}) == 100 and sorted(r.label for r in got) == sorted([*range(50), *range(50)])


def test_roots_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, 128, dtype=np.uint32)
    rows = [{"node": int(n), "sketch": base.tobytes() if n % 3 else rng.integers(0, 2**32, 128, dtype=np.uint32).tobytes(), "tile": int(n % 2), "a": 0, "b": 1} for n in rng.permutation(40)]
    runs = [jaccard_join.prune(pa.Table.from_pylist(order), 0.8, 1e-9).to_pylist() for order in (rows, rows[::-1])]
    assert runs[0] and runs[0] == runs[1]


def test_roots_of_many_tiles_contract_to_one_edge_a_node(spark):
    """A group of 400 nodes compared in 20 tiles names a root for each node and tile; one edge a node is left."""
    tiles = [range(20 * t, 20 * t + 20) for t in range(20)]
    edges = [(v, min(s[0], t[0])) for s in tiles for t in tiles for v in s]
    left = contracted(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(tuple(r) for r in left) == [(v, 0) for v in range(1, 400)]


def test_components_equal_union_of_sets_on_random_graphs(spark):
    rng = random.Random(23)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    group = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in group:
        for a, b in edges:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == group

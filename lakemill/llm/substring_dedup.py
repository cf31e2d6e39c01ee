"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

The documents in order of their ids are cut into blocks of about BLOCK_BYTES. The index of a block is the
sorted set of the hashes of its windows of 13 words, with their places. Hashes of all blocks meet by hash
range: a task tells each block which of its windows stand in an earlier block, and names the nearest one.

A stretch of windows with one such block is sent there as words. In the reference block it is parsed
greedily from left to right: the index gives a place of the first window, and the factor grows word by word
from that place on in the reference text, words compared, as far as both go on alike. The next factor begins
where the first window ends that this one does not hold, so windows across the boundary of two factors are
looked up and compared too. Factors have 13 words or more, and each is one passage of one document: its
block, that document's id and the word at which it starts come with it. Windows that an earlier document of
the same block holds are parsed in the same way against that block itself. The factors are the spans that go.

A window has one entry in a block's index, and a block asks for it in one other block at most, and is asked for
it by one at most (the next that has it). So no block is asked for more than it holds, whatever the copies.
Two different windows with one 64-bit hash cannot delete anything, since words are compared; a repeat
would be left where the nearest block has only the other one, about n * n / 2**65 cases in n windows.

Texts are shuffled once and read from that shuffle by every pass. Blocks are cut by bytes: quantiles of the
ids, each id counted by the size of its text. At most MOST_BOUNDS of them come to the driver; beyond that a
range between two of them is cut evenly. An id that fills more than a block is spread over several by a hash.

Defined results: a null or empty text has no words and nothing is removed; documents with one id do not
refer to each other; one without an id is neither reference nor changed. The key is a whole number; other
types are refused. Other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.llm.batches import numbered_words, whole_numbers
from lakemill.llm.hashing import window_hashes
from lakemill.sources.tables import read_table

WINDOW = 13
BLOCK_BYTES = 4_000_000
WINDOWS_A_RANGE = 2_000_000
#: Bytes of text that make one word, roughly, to choose the number of hash ranges.
BYTES_A_WORD = 6
LEAST_RANGES = 32
#: Bounds of blocks that the driver sees at most, and bytes for which an id counts once more.
MOST_BOUNDS = 20_000
BYTES_A_VOTE = 4_096
#: A block's number: place of its bounds, place between them, and whether it holds one id alone.
PART_BITS = 20
WORD = r"[^\x20\x09-\x0D]+"


def last_at_most(values: list[int], key: Column) -> Column:
    """Number of the sorted values up to the key: a binary search written as a fold over the steps."""
    steps = [1 << i for i in reversed(range(max(1, len(values).bit_length())))]
    listed = F.lit(np.array(values, np.int64)) if values else F.array().cast("array<bigint>")
    fits = lambda at: F.coalesce((at <= len(values)) & (F.get(listed, at - 1) <= key), F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def in_blocks(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``docs`` with a block number that grows with the key, and the number of hash ranges."""
    at, size = F.col(key).cast("long"), F.coalesce(F.octet_length(F.col(text)), F.lit(0))
    total, least, most = docs.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.min(at), F.max(at)).first()
    wanted = max(1, -(-total // BLOCK_BYTES))
    n = min(wanted, MOST_BOUNDS)
    cuts: Counter = Counter()
    if n > 1 and least is not None:
        votes = docs.select(at.alias("at"), F.explode(F.array_repeat(F.lit(0), (size / BYTES_A_VOTE).cast("int") + 1)))
        cuts = Counter(votes.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 20 * n)).first()[0] or ())
    alone = {k: times for k, times in cuts.items() if times > 1}
    bounds = sorted({*cuts, *(k + 1 for k in alone if k < 2**63 - 1)})
    edges = [least or 0, *bounds, (most or 0) + 1]
    parts = [alone.get(low, -(-wanted // n)) for low in edges[:-1]]
    place = last_at_most(bounds, at)
    pick = lambda values, kind: F.get(F.lit(np.array(values, kind)), place)
    low, high, many = pick(edges[:-1], np.float64), pick(edges[1:], np.float64), pick(parts, np.int64)
    single = pick([int(x in alone) for x in edges[:-1]], np.int64)
    between = F.least(many - 1, F.floor((at.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * many))
    part = F.when(single == 1, F.pmod(F.xxhash64(F.col(text)), many)).otherwise(F.greatest(between, F.lit(0)))
    block = F.shiftleft(F.shiftleft(place.cast("long"), PART_BITS) + part, 1) + single
    ranges = max(LEAST_RANGES, -(-total // (BYTES_A_WORD * WINDOWS_A_RANGE)))
    return docs.withColumn("__block", block), int(ranges)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of equal width, in order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


class Block:
    """A block's documents in order of their keys, as numbered words, with the hashes of their windows.

    ``more`` are texts that are numbered together with the documents and follow them.
    """

    def __init__(self, table: pa.Table, more: list[str] = ()) -> None:
        #: Rows with one key and one text are alike, so every pass may number them as they come.
        table = table.sort_by([("key", "ascending"), ("sum", "ascending")]).combine_chunks()
        self.number = table.column("block")[0].as_py() if len(table) else -1
        self.rows, self.n = table, len(table)
        texts = table.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts
        self.words, self.counts, self.distinct = numbered_words(pa.array([*texts.to_pylist(), *more], pa.string()) if more or not isinstance(texts, pa.Array) else texts)
        self.hashes, self.at, self.text_of = window_hashes(self.words, self.counts, self.distinct, WINDOW)
        self.ends = np.cumsum(self.counts)
        self.keys = table.column("key").to_numpy()


def index_of(block: pa.Table, ranges: int) -> pa.Table:
    """Rows (range, block, hashes): the block's index, cut by hash range; bytes of equal weight stand together."""
    held = Block(block)
    hashes = np.unique(held.hashes)
    at = range_of(hashes, ranges)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    parts = np.split(hashes, first[1:]) if len(at) else []
    packed = [p.view(np.uint8).reshape(-1, 8).T.tobytes() for p in parts]
    return pa.table({"range": pa.array(at[first].astype(np.int32)), "block": pa.array([held.number] * len(parts), pa.int64()), "hashes": pa.array(packed, pa.binary())})


ANSWERS = "block long, range int, n int, flags binary, refs array<long>, picks binary"


def earlier_blocks(rows: pa.Table) -> pa.Table:
    """For one hash range: which entries of each block stand in an earlier block, and in which one nearest before."""
    rows = rows.sort_by("block")
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for b in rows.column("hashes").to_pylist()]
    lengths = np.array([len(p) for p in parts])
    hashes, owner = np.concatenate(parts), np.repeat(rows.column("block").to_numpy(), lengths)
    order = np.argsort(hashes, kind="stable")
    by_hash, by_owner = hashes[order], owner[order]
    #: Blocks of one id alone do not refer to each other, so they count as one.
    group = np.where(by_owner & 1, by_owner >> (PART_BITS + 1) << (PART_BITS + 1) | 1, by_owner)
    fresh = np.r_[True, (by_hash[1:] != by_hash[:-1]) | (group[1:] != group[:-1])]
    before = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) - 1
    there = (before >= 0) & (by_hash[before] == by_hash)
    nearest = np.full(len(order), -1, np.int64)
    nearest[order] = np.where(there, by_owner[before], -1)
    out: dict[str, list] = {"flags": [], "refs": [], "picks": []}
    for end, n in zip(np.cumsum(lengths), lengths):
        mine = nearest[end - n : end]
        refs, picks = np.unique(mine[mine >= 0], return_inverse=True)
        out["flags"].append(np.packbits(mine >= 0).tobytes())
        out["refs"].append(refs.tolist())
        out["picks"].append(picks.astype(np.int32).tobytes())
    return pa.table(
        {
            "block": rows.column("block"),
            "range": rows.column("range"),
            "n": pa.array(lengths.astype(np.int32)),
            "flags": pa.array(out["flags"], pa.binary()),
            "refs": pa.array(out["refs"], pa.list_(pa.int64())),
            "picks": pa.array(out["picks"], pa.binary()),
        }
    )


def references(answers: pa.Table, n: int) -> np.ndarray:
    """For each entry of a block's index the nearest earlier block that has it, or -1."""
    out = np.full(n, -1, np.int64)
    at = 0
    for row in answers.sort_by("range").to_pylist():
        flags = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=row["n"]).astype(bool)
        out[at : at + row["n"]][flags] = np.array(row["refs"], np.int64)[np.frombuffer(row["picks"], np.int32)]
        at += row["n"]
    assert at == n, (at, n)
    return out


def alike(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, ``most`` at most."""
    n, step = 0, 32
    while n < most:
        step = min(step, most - n)
        same = words[a + n : a + n + step] == words[b + n : b + n + step]
        if not same.all():
            return n + int(same.argmin())
        n, step = n + step, 2 * step
    return n


def parse(words: np.ndarray, start: int, end: int, place: np.ndarray, stop_of: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy factors (start, length, place in the reference) of the words from ``start`` to ``end``.

    ``place`` has for each window from ``start`` on where the reference index has it first, or -1, and
    ``stop_of`` where the document there ends. A hash without equal words makes no factor.
    """
    out, at = [], start
    while at + WINDOW <= end:
        to = int(place[at - start])
        length = alike(words, at, to, min(end - at, int(stop_of[at - start]) - to)) if to >= 0 else 0
        if length >= WINDOW:
            out.append((at, length, to))
        at += max(1, length - WINDOW + 1)
    return out


FACTOR = "start long, length long, block long, key long, at long"
FOUND = f"ref long, target long, row int, start long, words string, factors array<struct<{FACTOR.replace(' ', ':').replace(',:', ', ')}>>"
FACTORS = pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in FACTOR.split(", ")]))


def found_in(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows for one block: factors within it, and stretches of words for the earlier block that may hold them."""
    held = Block(block)
    unique, first, inverse = np.unique(held.hashes, return_index=True, return_inverse=True)
    place = held.at[first][inverse] if len(unique) else held.at
    inside = held.keys[held.text_of] > held.keys[held.text_of[first][inverse]] if len(unique) else np.zeros(0, bool)
    refs = np.where(inside, held.number, references(answers, len(unique))[inverse])
    change = np.flatnonzero((refs[1:] != refs[:-1]) | (held.text_of[1:] != held.text_of[:-1])) + 1
    begins, ends = np.r_[0, change], np.r_[change, len(refs)]
    some = np.flatnonzero(refs[begins] >= 0) if len(refs) else []
    starts, stop_of = held.ends - held.counts, held.ends[held.text_of[first][inverse]] if len(unique) else held.at
    out: dict[str, list] = {c: [] for c in ("ref", "row", "start", "words", "factors")}
    for i in some:
        a, b = int(begins[i]), int(ends[i])
        ref, row, start, end = int(refs[a]), int(held.text_of[a]), int(held.at[a]), int(held.at[b - 1]) + WINDOW
        own = ref == held.number
        out["ref"].append(ref)
        out["row"].append(row)
        out["start"].append(start - int(starts[row]))
        out["words"].append(None if own else b" ".join(map(held.distinct.__getitem__, held.words[start:end].tolist())).decode())
        out["factors"].append(named(held, parse(held.words, start, end, place[a:b], stop_of[a:b]), start) if own else None)
    kinds = {"ref": pa.int64(), "row": pa.int32(), "start": pa.int64(), "words": pa.string(), "factors": FACTORS}
    columns = {c: pa.array(out[c], kind) for c, kind in kinds.items()}
    return pa.table({"ref": columns["ref"], "target": pa.array([held.number] * len(some), pa.int64()), **{c: columns[c] for c in ("row", "start", "words", "factors")}})


def named(held: Block, factors: list[tuple[int, int, int]], origin: int) -> list[dict]:
    """Factors with starts from ``origin``, and their block, document and word in it."""
    out = []
    for start, length, to in factors:
        doc = int(np.searchsorted(held.ends, to, side="right"))
        out.append({"start": start - origin, "length": length, "block": held.number, "key": int(held.keys[doc]), "at": to - int(held.ends[doc] - held.counts[doc])})
    return out


REPLIES = FOUND.replace("ref long, ", "").replace("words string, ", "")


def parsed_in(block: pa.Table, found: pa.Table) -> pa.Table:
    """Rows for the blocks that asked: the factors of their stretches, parsed against this block's text."""
    asked = found.column("words").to_pylist()
    stretches = list(dict.fromkeys(w for w in asked if w is not None))
    known: dict[str | None, list] = {}
    if stretches and len(block):
        held = Block(block, stretches)
        own = held.text_of < held.n
        unique, first = np.unique(held.hashes[own], return_index=True)
        mine = np.flatnonzero(~own)
        at = np.minimum(np.searchsorted(unique, held.hashes[mine]), max(0, len(unique) - 1))
        there = unique[at] == held.hashes[mine] if len(unique) else np.zeros(len(mine), bool)
        place = np.where(there, held.at[first[at]], -1) if len(unique) else np.full(len(mine), -1)
        stop_of = np.where(there, held.ends[held.text_of[first[at]]], 0) if len(unique) else place
        of = held.text_of[mine] - held.n
        bounds = np.searchsorted(of, np.arange(len(stretches) + 1))
        for i, words in enumerate(stretches):
            start, end = int(held.ends[held.n + i] - held.counts[held.n + i]), int(held.ends[held.n + i])
            known[words] = named(held, parse(held.words, start, end, place[bounds[i] : bounds[i + 1]], stop_of[bounds[i] : bounds[i + 1]]), start)
    factors = [f if w is None else known.get(w, []) for w, f in zip(asked, found.column("factors").to_pylist())]
    return found.drop_columns(["ref", "words", "factors"]).append_column("factors", pa.array(factors, FACTORS))


def kept_words(text: str | None, factors: list[dict]) -> tuple[int, int, str]:
    """Words, removed words, and the other words joined by a space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    keep = np.ones(len(words), bool)
    for f in factors:
        keep[f["start"] : f["start"] + f["length"]] = False
    kept = words if keep.all() else list(compress(words, keep))
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")


def without_repeats(block: pa.Table, replies: pa.Table) -> pa.Table:
    """The block's rows with words, removed words, kept text and factors."""
    block = block.sort_by([("key", "ascending"), ("sum", "ascending")])
    factors: list[list[dict]] = [[] for _ in range(len(block))]
    for r in replies.to_pylist():
        factors[r["row"]] += [f | {"start": f["start"] + r["start"]} for f in r["factors"]]
    factors = [sorted(fs, key=lambda f: f["start"]) for fs in factors]
    done = [kept_words(t, fs) for t, fs in zip(block.column("text").to_pylist(), factors)]
    out = block.drop_columns(["block", "sum"])
    for name, kind, values in (("n_words", pa.int64(), [d[0] for d in done]), ("n_removed", pa.int64(), [d[1] for d in done]), ("kept", pa.string(), [d[2] for d in done]), ("factors", FACTORS, factors)):
        out = out.append_column(name, pa.array(values, kind))
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: key, text, n_words, n_removed, kept, factors and c0, c1, ... for ``carry``.

    ``kept`` has the words that are left, joined by one space. A factor has its first word and its length
    here, and the block, the key and the first word of the passage that it repeats.
    """
    whole_numbers(docs, key)
    known = docs.filter(F.col(key).isNotNull())
    blocked, ranges = in_blocks(known, key, text)
    columns = [F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]]
    rows = blocked.select(F.col("__block").alias("block"), F.xxhash64(F.col(text)).alias("sum"), *columns)
    index = rows.groupBy("block").applyInArrow(lambda t: index_of(t, ranges), "range int, block long, hashes binary")
    answers = index.groupBy("range").applyInArrow(earlier_blocks, ANSWERS)
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(found_in, FOUND)
    replies = rows.groupBy("block").cogroup(found.groupBy("ref")).applyInArrow(parsed_in, REPLIES)
    factors = T.ArrayType(T.StructType([T.StructField(c.split()[0], T.LongType()) for c in FACTOR.split(", ")]))
    kind = T.StructType([f for f in rows.schema.fields if f.name not in ("block", "sum")]).add("n_words", "long").add("n_removed", "long").add("kept", "string").add("factors", factors)
    done = rows.groupBy("block").cogroup(replies.groupBy("target")).applyInArrow(without_repeats, kind)
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    others = docs.filter(F.col(key).isNull()).select(*columns)
    others = others.select("*", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words, " ").alias("kept"), F.array().cast(factors).alias("factors"))
    return done.unionByName(others)


def strip_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated spans; a text that loses nothing stays as it is, one that loses all goes."""
    carry = tuple(c for c in docs.columns if c not in (key, text))
    done = dedup(docs, key, text, carry).filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(carry)}
    back |= {key: F.col("key").cast(docs.schema[key].dataType).alias(key), text: F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")).alias(text)}
    return done.select(*[back[c] for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT r, doc_id, i, words[i:i + {WINDOW - 1}] AS win FROM w, LATERAL unnest(range(1, len(words) - {WINDOW - 2})) u(i)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY win) AS least FROM p) WHERE least < doc_id),
c AS (SELECT DISTINCT r, i + j AS pos FROM f, LATERAL unnest(range(0, {WINDOW})) u(j)),
k AS (SELECT w.r, w.doc_id, n.pos, w.words[n.pos] AS word FROM w, LATERAL unnest(range(1, len(w.words) + 1)) n(pos)),
s AS (
  SELECT k.r, count(c.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k.pos) FILTER (c.pos IS NULL), '') AS kept
  FROM k LEFT JOIN c ON c.r = k.r AND c.pos = k.pos GROUP BY k.r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (r)
"""

"""Byte-level BPE with a minimal acyclic transducer of frequent words.

The words of the whole corpus are counted by Spark; the most frequent ones (a bounded number) are
merged once and compiled into an acyclic automaton whose equal suffixes are shared. A path through it
adds up to the word's number, and the number points to the word's ids. The automaton is a few flat
arrays in one file, which Spark sends to every executor and each worker maps into memory. Words that
it lacks are merged exactly, so its size changes the speed and never the ids.

A worker takes some megabytes of text at a time and gives their ids before it takes more. It cuts them into
words with arrays over their characters; each different word is looked up once, and the ids of all words
are put together by one gather. The tokenizer file is read once, by the driver. Many short words merge side
by side, a long word by a heap of its pairs, so the time follows the length of a text even where it has no
break.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded one by one; other columns pass through. The special token's own string in a text is that token.
"""

from __future__ import annotations

import atexit
import functools
import heapq
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.lineage import settle
from lakemill.llm.batches import slices_of, steps, text_bytes
from lakemill.sources.tables import read_table

#: Words in the automaton at most, and how often a word must stand in the corpus to be counted as frequent.
LEXICON_WORDS = 150_000
LEAST_COUNT = 3
#: Bytes of text in one step of a worker.
STEP_BYTES = 1_000_000
#: Words of more bytes are merged one by one, with a heap.
LONG_WORD = 128
NO_PAIR = np.int64(1) << 62
#: What follows an apostrophe as a word of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, by the rule of byte-level BPE:
    printable Latin-1 characters stand for themselves, other bytes take characters from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(rest)): b for b in range(256)}


class Runs:
    """Many runs of numbers in one array; ``edges`` says where each begins and the last ends."""

    def __init__(self, data: np.ndarray, edges: np.ndarray) -> None:
        self.data, self.edges = data, edges

    @classmethod
    def of(cls, runs: list) -> Runs:
        return cls(np.concatenate([np.asarray(r) for r in runs]) if runs else np.zeros(0, np.int64), np.cumsum([0, *map(len, runs)]))

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        return cls(np.concatenate([p.data for p in parts]), np.r_[0, np.cumsum(np.concatenate([p.lengths() for p in parts]))])

    def lengths(self) -> np.ndarray:
        return np.diff(self.edges)

    def pick(self, which: np.ndarray) -> Runs:
        """The runs of these numbers, in this order."""
        lengths = self.lengths()[which]
        edges = np.r_[0, np.cumsum(lengths)]
        return Runs(self.data[np.repeat(self.edges[:-1][which] - edges[:-1], lengths) + np.arange(edges[-1])], edges)


class Vocabulary:
    """Ids, bytes and merge ranks from a tokenizer file."""

    def __init__(self, content: str) -> None:
        model = json.loads(content)
        byte_of = printable_bytes()
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.long_ranks: dict[int, int] | None = None
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.array([vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        #: Both ids in one number, sorted, and the ranks; a rank gives the merged id.
        ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs = np.array(sorted(ranks), np.int64)
        self.ranks = np.array([ranks[k] for k in self.pairs.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or NO_PAIR; a negative id has no pair."""
        key = np.where((left < 0) | (right < 0), -1, left << 20 | right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_PAIR)

    def merge(self, words: Runs) -> Runs:
        """The ids of many words."""
        long = np.flatnonzero(words.lengths() > LONG_WORD)
        short = np.flatnonzero(words.lengths() <= LONG_WORD)
        parts = [self.merge_short(words.pick(short)), *(Runs.of([self.merge_long(words.data[words.edges[i] : words.edges[i + 1]])]) for i in long.tolist())]
        return Runs.joined(parts).pick(np.argsort(np.r_[short, long]))

    def merge_short(self, words: Runs) -> Runs:
        """In each round every word merges its pair of the lowest rank, the leftmost among equals.

        A pair is its rank and the place of its left part in one number, so the least number of a word is
        the pair to merge. Merged parts are chained, not moved, and only the two pairs beside a merge are
        looked up again. Words without a pair leave when they are the greater part.
        """
        lengths, word = words.lengths(), np.arange(len(words.edges) - 1)
        word, lengths = word[lengths > 0], lengths[lengths > 0]
        ids = self.byte_id[words.data]
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.flatnonzero(words.lengths() == 0), np.zeros((words.lengths() == 0).sum(), np.int64), ids[:0])]
        while len(word):
            n, starts = len(ids), np.cumsum(lengths) - lengths
            #: The place after the last stands for "nothing beside".
            after, before, part = np.arange(1, n + 1), np.append(np.arange(-1, n - 1), n), np.append(ids, -1)
            after[starts + lengths - 1], before[starts] = n, n
            rank = self.rank_of(ids, part[after])
            pair = np.append(np.where(rank == NO_PAIR, NO_PAIR, rank << 40 | np.arange(n)), NO_PAIR)
            best = np.minimum.reduceat(pair[:n], starts)
            while 2 * np.count_nonzero(best != NO_PAIR) > len(word):
                best = best[best != NO_PAIR]
                at = best & ((1 << 40) - 1)
                gone = after[at]
                part[at], part[gone], pair[gone] = self.merged[best >> 40], -2, NO_PAIR
                after[at] = after[gone]
                before[after[at]] = at
                before[n] = n
                beside = np.concatenate([at, before[at]])
                beside = beside[beside < n]
                rank = self.rank_of(part[beside], part[after[beside]])
                pair[beside] = np.where(rank == NO_PAIR, NO_PAIR, rank << 40 | beside)
                best = np.minimum.reduceat(pair[:n], starts)
            kept = part[:n] >= 0
            lengths = np.add.reduceat(kept, starts, dtype=np.int64)
            ids, done = part[:n][kept], best == NO_PAIR
            gone = np.repeat(done, lengths)
            ready.append((word[done], lengths[done], ids[gone]))
            ids, word, lengths = ids[~gone], word[~done], lengths[~done]
        order, lengths, ids = (np.concatenate(x) for x in zip(*ready))
        return Runs(ids, np.r_[0, np.cumsum(lengths)]).pick(np.argsort(order))

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """The same for one word, with a heap of its pairs: n log n in its length."""
        part = self.byte_id[word]
        first = self.rank_of(part[:-1], part[1:])
        there = np.flatnonzero(first != NO_PAIR)
        heap = list(zip(first[there].tolist(), there.tolist(), part[there].tolist(), part[there + 1].tolist()))
        heapq.heapify(heap)
        ids, n = part.tolist(), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = dict(zip(self.pairs.tolist(), self.ranks.tolist())) if self.long_ranks is None else self.long_ranks
        self.long_ranks, merged = rank_of, self.merged
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            to = after[at]
            if ids[at] != left or to >= n or ids[to] != right:
                continue
            ids[at], ids[to] = int(merged[rank]), -1
            after[at] = after[to]
            if after[at] < n:
                before[after[at]] = at
            for a, b in ((before[at], at), (at, after[at])):
                if a >= 0 and b < n:
                    fresh = rank_of.get(ids[a] << 20 | ids[b])
                    if fresh is not None:
                        heapq.heappush(heap, (fresh, a, ids[a], ids[b]))
        return np.array([x for x in ids if x >= 0], np.int64)


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """The minimal acyclic automaton of ``words`` with their ids, as flat arrays.

    Words come in order; when a branch is left, its states are looked up by their content, so equal
    suffixes become one state. Each edge carries the number of words before its branch, so the sum on a
    path is the word's place in order.
    """
    ordered = sorted(words)
    known: dict[tuple, int] = {}
    final, counts, edges = [], [], []

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(final)
            final.append(node[0])
            counts.append(int(node[0]) + sum(counts[t] for _, t in node[1]))
            edges.append(key[1])
        return known[key]

    path: list[list] = [[False, []]]
    before = b""
    for word in ordered:
        shared = 0
        while shared < min(len(before), len(word)) and before[shared] == word[shared]:
            shared += 1
        for depth in range(len(before), shared, -1):
            path[depth - 1][1].append((before[depth - 1], close(path.pop())))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1][1].append((before[depth - 1], close(path.pop())))
    root = close(path[0])
    label, target, skip = [], [], []
    for state, out in enumerate(edges):
        run = int(final[state])
        for byte, to in out:
            label.append(state << 8 | byte)
            target.append(to)
            skip.append(run)
            run += counts[to]
    ids = [words[w] for w in ordered]
    offsets = np.cumsum([0, *map(len, ids)]) // 4
    arrays = [np.array(x, np.int32) for x in (final, label, target, skip, offsets)] + [np.frombuffer(b"".join(ids), np.int32)]
    return np.array([root, *map(len, arrays)], np.int32).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The automaton in a file that is mapped, not read."""

    def __init__(self, path: str) -> None:
        mapped = np.asarray(np.memmap(path, np.int32, "r"))
        self.root, at = int(mapped[0]), 7
        parts = []
        for n in mapped[1:7].tolist():
            parts.append(mapped[at : at + n])
            at += n
        self.final, self.edge, self.target, self.skip, self.offsets, self.ids = parts

    def find(self, words: Runs) -> np.ndarray:
        """The number of each word, or -1; all words take a step together."""
        lengths, starts = words.lengths(), words.edges[:-1]
        n = len(lengths)
        state, number = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        alive = np.arange(n if len(self.edge) else 0)
        for step in range(int(lengths.max(initial=0))):
            alive = alive[lengths[alive] > step]
            key = state[alive] << 8 | words.data[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            there = self.edge[at] == key
            state[alive[~there]] = -1
            alive, at = alive[there], at[there]
            number[alive] += self.skip[at]
            state[alive] = self.target[at]
            if not len(alive):
                break
        return np.where((state >= 0) & (self.final[state] > 0), number, -1)

    def outputs(self) -> Runs:
        """The ids of each word, by its number."""
        return Runs(self.ids, self.offsets)


@functools.cache
def character_classes() -> np.ndarray:
    """The class of each code point, found once in a worker."""
    out = np.full(0x110000, OTHER, np.uint8)
    for start in range(0, 0x110000, 0x800):
        if 0xD800 <= start < 0xE000:
            continue
        block = "".join(map(chr, range(start, start + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for found in regex.finditer(pattern, block):
                out[start + found.start() : start + found.end()] = kind
    return out


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 characters that begin at the places ``at``."""
    lead = data[at].astype(np.uint32)
    out = lead.copy()
    for least, more in ((0xC0, 1), (0xE0, 2), (0xF0, 3)):
        wide = np.flatnonzero((lead >= least) & (lead < (0xE0, 0xF0, 0xF8)[more - 1]))
        point = lead[wide] & (0x3F >> more)
        for i in range(1, more + 1):
            point = point << 6 | data[np.minimum(at[wide] + i, len(data) - 1)] & 0x3F
        out[wide] = point
    return np.minimum(out, 0x10FFFF)


class Words:
    """Texts cut into words.

    A word is a run of letters, of numbers or of other characters, each with one blank before it, or
    white space: the last of a run of white space before something else stands alone, unless it is the
    blank that belongs to the next word. An apostrophe that begins a word and one of CONTRACTIONS after it
    are a word. Special tokens are words of their own, and what stands beside them is cut apart.
    """

    def __init__(self, special: list[str]) -> None:
        self.classes = character_classes()
        self.special = [x.encode() for x in special]
        self.pattern = re.compile(b"|".join(map(re.escape, self.special))) if special else None

    def cut(self, column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """All words, as numbers of the different ones, and where each text's words begin and the last end."""
        data, offsets = text_bytes(column)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        inside = []
        for special in self.special:
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, special.decode()), False).to_numpy(zero_copy_only=False)).tolist():
                for found in self.pattern.finditer(data[offsets[i] : offsets[i + 1]].tobytes()):
                    inside.append(offsets[i] + np.array(found.span()))
                    first[inside[-1]] = True
        begins = np.zeros(len(data) + 1, bool)
        begins[at[self.begins(code_points(data, at), first[at])]] = True
        for a, b in inside:
            begins[a + 1 : b] = False
        begins[-1] = False
        edges = np.append(np.flatnonzero(begins), len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        return words.dictionary_encode(), np.searchsorted(edges, offsets)

    def begins(self, point: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters begin a word; ``first`` says which begin a text or stand beside a special token."""
        n, kind = len(point), self.classes[point]
        space = kind == SPACE
        last = np.append(first[1:], True)
        new, blank_before = np.ones(n, bool), np.zeros(n, bool)
        new[1:] = first[1:] | (kind[1:] != kind[:-1])
        blank_before[1:] = (point[:-1] == ord(" ")) & ~first[1:]
        begins = first | (new & ~(blank_before & ~space))
        begins[:-1] |= space[:-1] & ~space[1:] & ~last[:-1]
        quotes = np.flatnonzero((point == ord("'")) & begins)
        for tail in CONTRACTIONS:
            there = quotes[quotes + len(tail) < n]
            for i, letter in enumerate(tail):
                there = there[(point[there + i + 1] == ord(letter)) & ~first[there + i + 1]]
            begins[there + 1] = False
            behind = there + 1 + len(tail)
            begins[behind[behind < n]] = True
        return begins


class Encoder:
    """Texts to ids in one worker."""

    def __init__(self, vocabulary: str | Vocabulary, lexicon: str | None) -> None:
        self.vocabulary = Vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.words = Words(list(self.vocabulary.special))
        #: Different words that were looked up, and how many of them the automaton had.
        self.asked = self.answered = 0

    def ids_of(self, words: pa.LargeBinaryArray) -> Runs:
        """The ids of different words: from the automaton, or merged."""
        edges, data = words.buffers()[1:]
        asked = Runs(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(edges, np.int64)[: len(words) + 1])
        number = self.lexicon.find(asked) if self.lexicon else np.full(len(words), -1)
        missing = np.flatnonzero(number < 0)
        self.asked, self.answered = self.asked + len(words), self.answered + len(words) - len(missing)
        merged = self.vocabulary.merge(asked.pick(missing))
        known = self.lexicon.outputs() if self.lexicon else Runs(merged.data[:0], np.zeros(1, np.int64))
        number[missing] = len(known.edges) - 1 + np.arange(len(missing))
        special = list(self.vocabulary.special)
        for i, token in enumerate(special):
            number[pc.equal(words, token.encode()).to_numpy(zero_copy_only=False)] = len(known.edges) - 1 + len(missing) + i
        return Runs.joined([known, merged, Runs.of([[self.vocabulary.special[x]] for x in special])]).pick(number)

    def encode(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text of a column."""
        words, bounds = self.words.cut(column)
        ids = self.ids_of(words.dictionary)
        numbers = words.indices.to_numpy()
        edges = np.r_[0, np.cumsum(ids.lengths()[numbers])][bounds]
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.pick(numbers).data.astype(np.int32)))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts; each step and each task sum up before the shuffle."""

    def count(batches):
        words = Words([])
        for batch in batches:
            for a, b in slices_of(batch.column(0), STEP_BYTES):
                found = words.cut(batch.column(0)[a:b])[0]
                times = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """Name of the automaton file that every executor can open; at most ``most`` words reach the driver."""
    counted = settle(word_counts(docs, text).filter(F.col("n") >= LEAST_COUNT))
    #: A row for each eighth of a power of two; the lowest one from which on the words are few enough is the limit.
    level = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for row in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        held += row["words"]
        if held > most:
            break
        least = row["level"]
    frequent = counted.filter(level >= least).select("word").collect() if least is not None else []
    words = [r["word"].encode("utf-8") for r in frequent]
    merged = Vocabulary(vocabulary).merge(Runs.of([np.frombuffer(w, np.uint8) for w in words]) if words else Runs(np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    ids = merged.data.astype(np.int32)
    content = compile_lexicon({w: ids[a:b].tobytes() for w, a, b in zip(words, merged.edges.tolist(), merged.edges[1:].tolist())})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    #: Executors fetch the file from the driver when their first task needs it, so it stays for the session.
    folder = tempfile.mkdtemp(prefix="lexicon-")
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, name)
    path.write_bytes(content)
    docs.sparkSession.sparkContext.addFile(str(path))
    return name


class Decoder:
    """Lists of ids to texts; bytes that are not UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        table: list[bytes | None] = [None] * (max(vocabulary.bytes_of) + 1)
        for i, raw in vocabulary.bytes_of.items():
            table[i] = raw
        self.table = pa.array(table, pa.large_binary())

    def decode(self, column: pa.ListArray) -> pa.Array:
        """One gather puts the bytes of all tokens in a row; texts are ranges of them."""
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        taken = self.table.take(column.flatten())
        if taken.null_count:
            raise ValueError("an id is not in the vocabulary")
        edges, data = taken.buffers()[1:]
        ends = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        edges = np.frombuffer(edges, np.int64)[ends] if len(taken) else np.zeros(len(ends), np.int64)
        texts = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(edges), data if data is not None else pa.py_buffer(b"")])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = texts.view(pa.large_binary()).to_pylist()
            return pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
        return texts.cast(pa.string())


def encoded_steps(encoder: Encoder, decoder: Decoder | None, columns: Iterator[pa.Array]) -> Iterator[pa.StructArray]:
    """(ids, decoded) of the texts of some columns, an array for each STEP_BYTES of them."""
    for texts in steps(columns, STEP_BYTES):
        ids = encoder.encode(texts)
        yield pa.StructArray.from_arrays([ids, decoder.decode(ids) if decoder else pa.nulls(len(texts), pa.string())], ["ids", "decoded"])


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None = None, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text; ``vocabulary`` is a tokenizer file's content.

    With ``decoded``, the text of the ids comes along under that name, from the same worker, so the ids
    need not be sent to another one. Results leave the worker step by step, so neither it nor the executor
    holds those of a whole Arrow batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    @F.arrow_udf(kind)
    def pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value, SparkFiles.get(lexicon) if lexicon else None)
        yield from encoded_steps(encoder, Decoder(encoder.vocabulary) if decoded else None, columns)

    both = docs.withColumn("__pieces", pieces.asNondeterministic()(F.col(text))).withColumn(into, F.col("__pieces.ids"))
    return (both.withColumn(decoded, F.col("__pieces.decoded")) if decoded else both).drop("__pieces")


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    @F.arrow_udf(T.StringType())
    def texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        yield from map(decoder.decode, columns)

    return docs.withColumn(into, texts.asNondeterministic()(F.col(ids)))


def vocabulary_file(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode all texts, decode them again, and give sizes and checksums of both."""
    vocabulary = vocabulary_file(path)
    encoded = encode(docs.select("doc_id", "text"), vocabulary, build_lexicon(docs, vocabulary), decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))

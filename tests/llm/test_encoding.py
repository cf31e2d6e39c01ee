"""BPE against the tokenizers library, and the pipeline against its parts."""

from __future__ import annotations

import functools
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lakemill.llm import bpe, jaccard_join, mixing, quality_rules, substring_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", "a", "  b  c\n\n d \t x", "I'm you're they'll 's''s don't 'tis x's\n's", "<|endoftext|>x <|endoftext|><|endoftext|> y ", "\xa0x\u3000 y\u2003\u2003z", "naïve 日本語 12³ ½ ٣",
    "\x1c a\x1f b\x85c", "🙂🙂 a\r\n\r\n", "é a\u200bb \ufeff", " " * 50, "x" * 3000, "the the the",
]


ENCODER = functools.cache(lambda: bpe.Encoder(bpe.vocabulary_file(PATH), None))
LIBRARY = functools.cache(lambda: Tokenizer.from_file(PATH))
DECODER = functools.cache(lambda: bpe.Decoder(ENCODER().vocabulary))


def noise(n):
    rng = random.Random(1)
    return ["".join(rng.choice(" \n\t'stremdvl0a1é!?\xa0\u3000\x1c日🙂<|") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def runs(words):
    return bpe.Runs.of([np.frombuffer(w, np.uint8) for w in words])


def expected(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_merging_equals_the_library_without_an_automaton():
    encoder = bpe.Encoder(bpe.vocabulary_file(PATH), None)
    texts = [*ODD, *noise(300)]
    assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == [expected(t)[0] for t in texts]
    assert encoder.encode(pa.array([*texts, "x"], pa.string())[5:9]).to_pylist() == [expected(t)[0] for t in texts[5:9]]
    assert encoder.encode(pa.array([], pa.string())).to_pylist() == encoder.encode(pa.array([None, ""], pa.string())).to_pylist()[2:] == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stremdvlTX0½!-_\xa0\u3000\x1c\x85日é<|endoftext>"), st.characters(codec="utf-8")), max_size=40) | st.none() | st.just("a<|endoftext|> b"), max_size=5))
def test_any_text_equals_the_library(texts):
    encoder, tokenizer, decoder = ENCODER(), LIBRARY(), DECODER()
    ids = encoder.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert decoder.decode(ids).to_pylist() == [t or "" for t in texts]


def test_long_words_merge_in_time_and_equal_the_library():
    rng = random.Random(7)
    texts = ["a" * 200_000, "".join(rng.choices("etaoinshr", k=200_000)), "日本" * 30_000, "-=" * 100_000, "ab" * 60 + " " + "x" * 129]
    encoder = bpe.Encoder(bpe.vocabulary_file(PATH), None)
    began = time.time()
    got = encoder.encode(pa.array(texts, pa.string())).to_pylist()
    assert time.time() - began < 60
    assert got == [expected(t)[0] for t in texts]


def test_automaton_is_minimal_and_exact(tmp_path):
    words = {w: bytes([i, 0, 0, 0]) * (i % 3 + 1) for i, w in enumerate(sorted({b"tap", b"taps", b"top", b"tops", b"a", "é".encode(), b"stop"}))}
    file = tmp_path / "lexicon.bin"
    file.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(file))
    number, ids = lexicon.find(runs(list(words))), lexicon.outputs()
    assert [ids.data[ids.edges[i] : ids.edges[i + 1]].tobytes() for i in number] == list(words.values())
    assert lexicon.find(runs([b"", b"t", b"ta", b"tapsy", b"zz", b"\xff"])).tolist() == [-1] * 6
    # root, t, the shared "ap"/"op" tails with an optional s, s, st, sto, the last p, and the end
    assert len(lexicon.final) < sum(map(len, words)) and len(set(zip(lexicon.edge.tolist(), lexicon.target.tolist()))) == len(lexicon.edge)
    file.write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(file)).find(runs([b"x"])).tolist() == [-1]


def test_query_equals_the_library(spark, docs, tables):
    texts = [*ODD, *noise(40), *(["and the other"] * 5)]
    got = {r["doc_id"]: r for r in entry.queries()["op7_bpe"](spark, tables(documents=docs(texts).withColumnRenamed("lang", "ids"))).collect()}
    for i, text in enumerate(texts):
        ids, decoded = expected(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert len(got) == len(texts)


def test_results_leave_a_worker_step_by_step():
    column = pa.array([*ODD, "some words of a text " * 30_000, *noise(200), "more words " * 70_000, *ODD], pa.string())
    steps = list(bpe.encoded_steps(ENCODER(), DECODER(), iter([column, column[:3], column[:0]])))
    sizes = [[len((t or "").encode()) for t in s.field("decoded").to_pylist()] for s in steps]
    assert len(steps) == 3 and all(len(x) == 1 or sum(x) <= bpe.STEP_BYTES for x in sizes)
    texts = column.to_pylist() + column[:3].to_pylist()
    assert [r["ids"] for s in steps for r in s.to_pylist()] == [LIBRARY().encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [r["decoded"] for s in steps for r in s.to_pylist()] == [t or "" for t in texts]


def test_an_arrow_batch_of_several_steps(spark):
    """More rows than a step in one Arrow batch, so results come in other pieces than the input."""
    texts = [f"{i} " + "several words in a row " * 40 for i in range(4000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = bpe.encode(rows, bpe.vocabulary_file(PATH), decoded="decoded").orderBy("doc_id").collect()
    assert [r["decoded"] for r in got] == texts
    assert [list(r["ids"]) for r in got] == [LIBRARY().encode(t, add_special_tokens=False).ids for t in texts]


def test_word_counts_and_broken_bytes(spark, docs):
    counted = {r["word"]: r["n"] for r in bpe.word_counts(docs(["the cat the", None, "", "the cat"])).collect()}
    assert counted == {"the": 2, " cat": 2, " the": 1}
    half = spark.createDataFrame([(bpe.Vocabulary(bpe.vocabulary_file(PATH)).byte_id[0xE9:0xEA].tolist(),), (None,), ([],)], "ids array<int>")
    assert sorted(r["decoded"] for r in bpe.decode(half, bpe.vocabulary_file(PATH)).collect()) == ["", "", "\ufffd"]


def test_pipeline_is_its_stages_in_order(spark, docs, tables):
    rng = random.Random(2)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passage = make(60)
    texts = [make(80) for _ in range(30)] + [f"{make(40)} {passage} {make(40)}" for _ in range(5)]
    texts += [texts[0], texts[1] + " more", "too short", "again and again " * 30, None, ""]
    folder = tables(documents=docs(texts))
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "substring_dedup", "mixing", "bpe"]
    kept = quality_rules.keep_good(frame)
    single = jaccard_join.one_of_each(kept)
    stripped = substring_dedup.strip_repeats(single)
    assert {r["doc_id"] for r in kept.collect()} == set(range(37))
    assert {r["doc_id"] for r in single.collect()} == set(range(35))
    holders = [r["doc_id"] for r in stripped.filter(f"text like '%{passage}%'").collect()]
    assert holders == [30]
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(stripped).collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    rows = sorted(r["doc_id"] for r in out)
    assert rows == sorted(i for i, n in mixed.items() for _ in range(n))
    text_of = {r["doc_id"]: r["text"] for r in stripped.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest() for r in out)
    before = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, folder)
        assert before.columns == frame.columns, name


def test_pipeline_of_nothing(spark, docs, tables):
    assert corpus_pipeline.run(spark, tables(documents=docs([]))).count() == 0

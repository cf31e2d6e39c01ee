"""Quality rules, license scan and the classifier against plain Python."""

from __future__ import annotations

import random
import re
import string

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakemill.llm import license_scan, quality_classifier, quality_rules
from lakemill.llm.catalogue import oracle_sql, queries
from tests.comparing import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest_repeats(words):
    """For each place the length of the longest run from there that also begins elsewhere."""
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def covered(longest, least, width=None):
    return len({i + k for i, n in enumerate(longest) if n >= least for k in range(width or n)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é\x0b\x85", max_size=40) | st.none(), max_size=6))
def test_counts_equal_brute_force(texts):
    got = quality_rules.measure(texts, 3)
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        longest = longest_repeats(words)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), (text or "").count("#"), len(lines) - len(set(lines)), covered(longest, 5, 5), covered(longest, 3), max(longest, default=0))
        assert tuple(int(got[c][i]) for c in quality_rules.COUNTS) == want


def test_rules_keep_clean_texts_and_reject_repetition(docs):
    rng = random.Random(1)
    clean = " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(300))
    passage = " ".join(clean.split()[:45])
    texts = [None, "", "too few words here", clean, f"{clean} {passage}", " ".join([passage] * 2), clean, "same words " * 40]
    df = docs(texts).withColumnRenamed("lang", "rules")
    judged = {r["doc_id"]: r["rules"] for r in quality_rules.judge(df).collect()}
    assert [judged[i]["kept"] for i in range(8)] == [False, False, False, True, False, False, True, False]
    assert [judged[i]["base_failed"] for i in (4, 5)] == [True, True]
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {3, 6}
    assert quality_rules.keep_good(docs([])).count() == 0


def test_quality_query_equals_sql(spark):
    same(spark, queries()["op9_quality_rules"], oracle_sql()["op9_quality_rules"])


BASE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_hits(text):
    words = BASE_WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    found = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return words, found


def test_scan_equals_brute_force_and_finds_inexact_notices(docs):
    apache = license_scan.TEMPLATES[3][0].split()
    dropped = " ".join(apache[:8] + apache[9:])
    texts = [
        None, "", "MIT", "mit license MIT-License mit license", "GNU General Public\nLicense", "Apache gnu general public license apache license.", "cc by cc by cc", f"intro {dropped} outro",
        "Licensed under CC BY-NC 4.0.", "mit license", "mit license", "ſ K apache LICENSE", "x " * 3000 + "cc by",
    ]
    df = docs(texts).withColumnRenamed("lang", "labels")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words, found = base_hits(text)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found)), i
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[7]["labels"] == "apache-notice" and 0.75 <= got[7]["score"] < 1
    assert got[8]["labels"] == "cc-by,cc-by-nc"
    assert license_scan.scan(docs([])).count() == 0


def test_rows_that_share_a_key_are_scanned_apart(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "none"), (1, "mit license"), (None, "cc by")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_base"]) for r in license_scan.scan(df).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]


def labelled(n, rng):
    good = lambda: " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: "BUY NOW!! $$$ " * rng.randint(5, 20)
    return [(good() if i % 2 else bad()) for i in range(n)], [i % 2 for i in range(n)]


def test_model_separates_and_sums_tables():
    texts, labels = labelled(200, random.Random(2))
    kinds = quality_classifier.character_kinds()
    x = np.array([quality_classifier.features(t, kinds) for t in texts])
    model = quality_classifier.fit(x, np.array(labels, float))
    p = quality_classifier.scores(model, x)
    assert ((p >= 0.5) == np.array(labels, bool)).mean() > 0.97
    one = model["start"] + sum(t[np.searchsorted(c, x[7, f], side="right")] for f, (t, c) in enumerate(zip(model["tables"], model["cuts"])))
    one += sum(t[np.searchsorted(model["coarse"][f], x[7, f], side="right"), np.searchsorted(model["coarse"][e], x[7, e], side="right")] for f, e, t in model["pairs"])
    assert abs(1 / (1 + np.exp(-one)) - p[7]) < 1e-12


def test_classifier_on_held_out_rows_and_odd_texts(spark, docs, tables):
    import zlib

    texts, labels = labelled(300, random.Random(3))
    folder = tables(documents=docs([*texts, None, "", texts[1]]), labels=spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)] + [(5, None, 0)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in queries()["op5_quality_classifier"](spark, folder).collect()}
    assert len(got) == 303
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"] and i < 300} == set(held)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.95
    assert got[302]["score"] == got[1]["score"] and 0 <= got[300]["score"] == got[301]["score"] <= 1


def test_classifier_without_labels(spark, docs, tables):
    folder = tables(documents=docs(["a b", None]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in queries()["op5_quality_classifier"](spark, folder).collect()} == {0.5}

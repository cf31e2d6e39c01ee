"""Quality rules: repetition inside a text, found with a suffix array of its words.

The words of a text are sorted by their suffixes (prefix doubling in numpy, many texts in one
array, each text apart). The longest common prefixes of neighbours in that order give every
maximal repeated run of words; the union of their spans says how much of a text is repetition.

Defined results: a null or empty text has no words, all counts 0, and fails the base rule.
Repeated rows are judged one by one. Other columns pass through; an existing column with the
name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.llm.batches import numbered_words, steps
from lakemill.sources.tables import read_table

SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 5
BASE_LEAST_WORDS = 10
BASE_MOST_REPEATED = 0.20
#: The method's own limits: repeats of so many words or more count, they may cover this part
#: of a text at most, and none may be longer than this.
MIN_REPEAT = 20
MAX_COVERED = 0.15
MAX_LONGEST = 400

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
RESULT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def suffix_order(words: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes with the suffix before.

    A suffix ends with its text, and suffixes of different texts share nothing.
    ``ends`` has for each position the end of its text.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = text_of * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(first, kind="stable")
    fresh = np.r_[True, first[order][1:] != first[order][:-1]]
    starts = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    rank = np.empty(n, np.int64)
    rank[order] = starts[group]
    sizes = np.diff(np.r_[starts, n])
    active = order[sizes[group] > 1]
    levels, k = [rank.astype(np.int32)], 1
    while active.size:
        far = active + k
        inside = far < ends[active]
        then = np.where(inside, rank[np.where(inside, far, 0)] + 1, 0)
        key = rank[active] * (n + 1) + then
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        group_first = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        at = np.arange(len(active))
        group_start = np.repeat(group_first, np.diff(np.r_[group_first, len(active)]))
        order[old + at - group_start] = active
        sub_first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sub_size = np.diff(np.r_[sub_first, len(active)])
        sub_start = np.repeat(sub_first, sub_size)
        rank[active] = old + sub_start - group_start
        levels.append(rank.astype(np.int32))
        active = active[np.repeat(sub_size, sub_size) > 1]
        k *= 2
    common = np.zeros(n, np.int64)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1 if n else np.zeros(0, np.int64)
    left, right = order[pairs - 1], order[pairs]
    end_left, end_right = ends[left], ends[right]
    shared = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        ok = (a < end_left) & (b < end_right)
        same = ok & (levels[level][np.where(ok, a, 0)] == levels[level][np.where(ok, b, 0)])
        shared += same.astype(np.int64) << level
    common[pairs] = shared
    return order, common


def repeated(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions inside the union of the repeats of ``least`` words or more."""
    n = len(longest)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + longest[at], 1)
    return np.cumsum(edge[:n]) > 0


def windows_repeated(longest: np.ndarray, width: int) -> np.ndarray:
    """Positions inside windows of ``width`` words that stand in the text twice or more."""
    return repeated(np.where(longest >= width, width, 0), width)


def measure(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text."""
    flat, counts, _ = numbered_words(texts)
    n_texts, n = len(texts), len(flat)
    text_of = np.repeat(np.arange(n_texts), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    order, common = suffix_order(flat, text_of, ends)
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(common, np.r_[common[1:], 0]) if n else common
    per_text = lambda mask: np.bincount(text_of[mask], minlength=n_texts)
    most = np.zeros(n_texts, np.int64)
    np.maximum.at(most, text_of, longest)
    chars, symbols, lines = (np.zeros(n_texts, np.int64) for _ in range(3))
    for i, text in enumerate(texts):
        if text:
            chars[i] = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
            symbols[i] = sum(map(text.count, SYMBOLS))
            filled = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            lines[i] = len(filled) - len(set(filled))
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": lines,
        "n_repeat_words": per_text(windows_repeated(longest, BASE_WINDOW)),
        "covered_words": per_text(repeated(longest, min_repeat)),
        "longest_repeat": most,
    }


def with_repetition(df: DataFrame, text: str = "text", into: str = "repetition", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``df`` with a struct of the counts of each text; no shuffle, one text at a time."""

    @F.arrow_udf(RESULT)
    def counts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in steps(columns):
            found = measure(texts.to_pylist(), min_repeat)
            yield pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in COUNTS], list(COUNTS))

    return df.withColumn(into, counts.asNondeterministic()(F.col(text)))


def base_failed(q: str) -> F.Column:
    n, r = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    return (n < BASE_LEAST_WORDS) | (100 * r > int(100 * BASE_MOST_REPEATED) * n)


def method_passed(q: str, max_covered: float, max_longest: int) -> F.Column:
    """The suffix-array verdict: too much of the text, or too long a run, is repetition."""
    return (F.col(f"{q}.covered_words") <= F.lit(max_covered) * F.col(f"{q}.n_words")) & (F.col(f"{q}.longest_repeat") <= max_longest)


def judge(df: DataFrame, text: str = "text", into: str = "rules", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """``df`` with a struct of counts and verdicts: base_failed, and kept."""
    counted = with_repetition(df, text, into)
    fields = [F.col(f"{into}.{c}").alias(c) for c in COUNTS]
    failed = base_failed(into)
    return counted.withColumn(into, F.struct(*fields, failed.alias("base_failed"), (~failed & method_passed(into, max_covered, max_longest)).alias("kept")))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns that came."""
    name = "__rules"
    return judge(df, text, name).filter(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in df.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", *[F.col(f"rules.{c}").alias(c) for c in COUNTS[:6]], (F.col("rules.longest_repeat") > MAX_LONGEST).alias("too_long_repeat"), "rules.base_failed", "rules.kept"
    )


#: Windows as lists of words; a run of 400 words and one more that stands twice is a repeated window of 401 words.
SQL = f"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), p AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (
  SELECT r, i, b, words[i:i + b - 1] AS win FROM p, (VALUES ({BASE_WINDOW}), ({MIN_REPEAT}), ({MAX_LONGEST + 1})) v(b)
  WHERE i + b - 1 <= len(words)
), twice AS (SELECT r, i, b FROM (SELECT r, i, b, count(*) OVER (PARTITION BY r, b, md5(win::VARCHAR), win) AS c FROM g WHERE b < {MAX_LONGEST}) WHERE c > 1),
hit AS (SELECT DISTINCT r, b, i + j AS at FROM twice, LATERAL unnest(range(0, b)) u(j)),
hits AS (SELECT r, count(*) FILTER (b = {BASE_WINDOW}) AS n5, count(*) FILTER (b = {MIN_REPEAT}) AS nm FROM hit GROUP BY r),
long AS (SELECT DISTINCT r FROM (SELECT r, md5(win::VARCHAR) AS h, count(*) AS c FROM g WHERE b = {MAX_LONGEST + 1} GROUP BY 1, 2) WHERE c > 1),
l AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), s AS (
  SELECT w.r, doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n5, 0)::BIGINT AS n_repeat_words,
         coalesce(nm, 0)::BIGINT AS covered_words, long.r IS NOT NULL AS too_long_repeat
  FROM w LEFT JOIN hits USING (r) LEFT JOIN l USING (r) LEFT JOIN long ON long.r = w.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, too_long_repeat,
       n_words < {BASE_LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * BASE_MOST_REPEATED)} * n_words AS base_failed,
       NOT (n_words < {BASE_LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * BASE_MOST_REPEATED)} * n_words)
         AND covered_words <= {MAX_COVERED}::DOUBLE * n_words AND NOT too_long_repeat AS kept
FROM s
"""

"""Hashes of runs of words, many texts in one array."""

from __future__ import annotations

import numpy as np
import xxhash

from lakemill.llm.batches import numbered_words


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(flat: np.ndarray, counts: np.ndarray, distinct: list[bytes], width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each place on, these places, and their texts.

    A place at the end of a text with fewer words left has no hash and is left out.
    """
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[flat]
    n = len(flat) - width + 1
    text_of = np.repeat(np.arange(len(counts)), counts)
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(odd_numbers(width, seed)):
        total += of_word[i : i + n] * factor
    inside = np.flatnonzero(text_of[:n] == text_of[width - 1 :])
    return mixed(total[inside]), inside, text_of[inside]


def run_hashes(texts: list[str | None], width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each place on, the places' texts, and words a text."""
    flat, counts, distinct = numbered_words(texts)
    hashes, _, text_of = window_hashes(flat, counts, distinct, width, seed)
    return hashes, text_of, counts

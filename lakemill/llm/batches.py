"""Small helpers that the Arrow functions of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that the numpy work of one step covers; a longer text makes a step of its own.
STEP_CHARS = 1_000_000
#: ASCII white space.
WHITE = b" \t\n\v\f\r"


def slices_of(column: pa.Array, most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` bytes each, before any text is a Python string."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(column):
        yield start, len(column)


def steps(columns: Iterator[pa.Array], most: int = STEP_CHARS) -> Iterator[pa.Array]:
    """Arrow columns cut by :func:`slices_of`, so that a worker holds results and Python objects of one step, not of a whole Arrow batch."""
    for column in columns:
        for a, b in slices_of(column, most):
            yield column[a:b]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each begins and the last ends; a null has none."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if (np.diff(offsets) == lengths).all():
        return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    return text_bytes(pc.fill_null(column, ""))


def numbered_words(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words between ASCII white space: their numbers, words a text, and the distinct words."""
    data, offsets = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    space = np.isin(np.arange(256), list(WHITE))[data]
    begins, first = ~space, np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins[1:] &= space[:-1] | first[1:-1]
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    letters = data[~space]
    edges = np.append(np.flatnonzero(begins[~space]), len(letters))
    words = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(letters)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), counts, words.dictionary.to_pylist()


def whole_numbers(docs: DataFrame, key: str) -> None:
    """Refuse a key that is no whole number: the operators that compare keys compare numbers."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"the key {key} must be a whole number, not {kind.simpleString()}")

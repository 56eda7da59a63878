"""Text columns in Arrow batches."""

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Texts of so many bytes are worked on at once in a task.
SLICE_BYTES = 4 << 20
WORD_BREAK = r"[^\pL\pM]+"


def filled(texts: pa.Array) -> pa.Array:
    """The texts with nulls as empty texts, in 64-bit offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts, "").cast(pa.large_string())


def giving_back(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function, which at its end gives the system what its arrays and tables took.

    Spark keeps a worker for later tasks, and the worker would keep that memory.
    """

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        # Not every C library has that.
        if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
            library.malloc_trim(0)

    return run


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of at most ``most`` bytes each, or of one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield texts[start:stop]
        start = stop


def encoded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of a list column: row offsets, the index of each entry, the distinct entries."""
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    entries = lists.flatten().dictionary_encode()
    return offsets, np.asarray(entries.indices), entries.dictionary.to_pylist()


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-case runs of letters, as from ``encoded``."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), WORD_BREAK)
    offsets, index, distinct = encoded(lists)
    if "" not in distinct:
        return offsets, index, distinct
    keep = index != distinct.index("")
    return np.concatenate([[0], np.cumsum(keep)])[offsets], index[keep], distinct


def hashes(strings: list[str]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    if not strings:
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(np.array(strings, dtype=object), categorize=False)


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between offsets; 0 for empty rows."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]

"""Vectorised word and shingle hashing over the byte buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1

#: Texts are hashed in runs of about this many bytes; one longer text is a run of its own.
RUN_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, byte offsets of the rows), with a bounded number of bytes each.

    A null text has no bytes.
    """
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in order, and the index of each row's first word (one more at the end)."""
    rows = len(offsets) - 1
    inside = ~space[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = offsets[:-1]
    at = at[at < len(data)]
    starts[at] = inside[at]  # a word never runs over the end of a text
    first = np.flatnonzero(starts)
    bounds = np.searchsorted(first, offsets)
    if not len(first):
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    where = np.flatnonzero(inside)
    begin = np.searchsorted(where, first)
    length = np.diff(np.append(begin, len(where)))
    relative = np.arange(len(where)) - np.repeat(begin, length)
    power = np.full(int(length.max()), U64(_BASE))
    power[0] = U64(1)
    power = np.multiply.accumulate(power)
    values = (_LOWER[data] if lower else data)[where].astype(U64)
    return mixed(np.add.reduceat((values + U64(1)) * power[relative], begin)), bounds


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within the row, and the rows' offsets.

    A row of fewer than ``words`` words, but not none, has its whole sequence as one shingle.
    """
    factors = mixed(np.arange(1, words + 1, dtype=U64) * U64(_BASE)) | U64(1)
    n = len(hashes) - words + 1
    full = np.zeros(max(n, 0), U64)
    for j in range(words):
        full += hashes[j : j + n] * factors[j] if n > 0 else full
    full = mixed(full)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            sets.append(mixed(np.array([(hashes[a:b] * factors[: b - a]).sum(dtype=U64)])))
        else:
            sets.append(np.zeros(0, U64))
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(lengths)])

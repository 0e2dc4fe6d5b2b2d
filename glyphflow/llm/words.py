"""Words of many texts at once, as numpy arrays.

A word is a run of bytes other than space and the five ASCII control spaces,
so UTF-8 texts can be cut without decoding. Everything here works on one
slice of rows at a time; `slices` keeps a slice small whatever Spark sends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once: numpy needs about forty bytes for each.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_CONTINUATION = np.zeros(256, bool)
_CONTINUATION[0x80:0xC0] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit factors that depend on the seed only."""
    with np.errstate(over="ignore"):
        steps = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps) | np.uint64(1)


_BYTE = odd_constants(256, 1_000_003)
_places = odd_constants(1 << 10, 17)


def places(n: int) -> np.ndarray:
    """The factors of byte positions 0 to n - 1; kept between calls."""
    global _places
    if n > len(_places):
        _places = odd_constants(max(n, 2 * len(_places)), 17)
    return _places


@dataclass
class Words:
    """Words of a slice: byte buffer, row offsets, and start, end and row of each word."""

    buffer: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self) -> np.ndarray:
        """Number of words of each row."""
        return np.bincount(self.row, minlength=self.rows)

    def first_of_row(self) -> np.ndarray:
        """Index of the first word of each row, and the total at the end."""
        return np.concatenate(([0], np.cumsum(self.per_row())))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    buffer = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return buffer, offsets - low


def cut(column: pa.Array, lower: bool) -> tuple[Words, np.ndarray]:
    """The words of a text column, and its bytes as they were."""
    raw, offsets = text_bytes(column)
    buffer = _LOWER[raw] if lower else raw
    inside = ~_SPACE[buffer]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(buffer))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    row = np.searchsorted(offsets, starts, "right") - 1
    return Words(buffer, offsets, starts, np.flatnonzero(end) + 1, row), raw


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hashes(words.buffer, words.start, words.end)


def span_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    at = within + np.repeat(start, length)
    with np.errstate(over="ignore"):
        terms = _BYTE[buffer[at]] * places(int(length.max()))[within]
        return mix(np.add.reduceat(terms, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive hashes, by its first; runs across rows are included."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(odd_constants(size, 5_000 + size)):
            total += hashes[k:k + n] * factor
    return mix(total)


def whole_windows(words: Words, size: int) -> np.ndarray:
    """For each run of `size` consecutive words, by its first: whether one row holds it."""
    n = len(words.row) - size + 1
    return words.row[:n] == words.row[size - 1:size - 1 + n] if n > 0 else np.zeros(0, bool)


def code_points(buffer: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte, and the total at the end."""
    return np.concatenate(([0], np.cumsum(~_CONTINUATION[buffer])))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of the text column, joined or cut from the batches; one row is never cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, before + limit - size, "right")))
            held.append(batch.slice(begin, stop - begin))
            size += int(total[stop - 1] - before)
            begin = stop
            if size >= limit or begin < batch.num_rows:
                yield _one(held)
                held, size = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)

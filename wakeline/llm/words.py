"""Words, lines and n-grams of many texts at once, with numpy over their UTF-8 bytes.

A batch of texts is one byte array and the offsets of the texts in it. Words are
runs of word bytes; all separators are ASCII, so bytes and code points give the
same words. A word is represented by a 64-bit hash: a polynomial over random
values of its bytes, mixed with its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 << 10

_RNG = np.random.default_rng(0x5EED)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LANES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: Bytes of words that end at white space, and of words of ASCII letters, digits and anything beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out[:n].copy()  # and not a view that keeps twice as much


_UP = _powers(_BASE, CHUNK_BYTES + 1)
_DOWN = _powers(_BASE_INV, CHUNK_BYTES + 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for ``n`` bytes; a text longer than a chunk gets longer ones for itself alone."""
    return (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(_BASE_INV, n + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a chunk. ``first[d]`` is the index of the first word of text d; ``first[-1]`` is the count."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans from ``prefix_hash``."""
    down = _tables(len(prefix))[1]
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(_BASE))


def prefix_hash(data: np.ndarray, fold: bool) -> np.ndarray:
    """Running polynomial of the bytes; entry i covers the first i. ``fold`` takes A-Z as a-z."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUE)[data] * _tables(len(data))[0][: len(data)], out=out[1:])
    return out


def scan(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, prefix: np.ndarray) -> Words:
    """Words of all texts; a word never goes over the end of its text."""
    inside = table[data]
    n = len(data)
    opens = np.zeros(n + 1, bool)
    opens[offsets[:-1][offsets[:-1] < n]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | opens[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | opens[1:])) + 1
    return Words(start, end, span_hash(prefix, start, end), np.searchsorted(start, offsets))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` words within a text, and the index of its first word."""
    h, n = words.hash, len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc += h[j : n - k + 1 + j] * _LANES[j]
    last = np.repeat(words.first[1:], words.count)  # of each word: where its text ends
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last[: n - k + 1])
    return mix(acc[at] + np.uint64(k)), at


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with at most ``limit`` bytes in ``column``, or one row: rows, bytes, offsets. Null counts as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = col.fill_null("")
        if not len(col):
            continue
        kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
        at = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
    release()


def release() -> None:
    """Give freed memory back: a worker that waits for its next task should not hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def with_columns(rows: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """The rows without ``drop``, with more columns."""
    keep = [i for i, n in enumerate(rows.schema.names) if n not in drop]
    return pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), *new.values()], [*(rows.schema.names[i] for i in keep), *new])

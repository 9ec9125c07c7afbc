"""What the operators of this subpackage share: written cut points, and vectorised words and shingles."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.plans.scratch import cut  # noqa: F401  operators take it from here

#: Bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. A text of one byte a character has only ASCII, where lower() does just that and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE = np.uint64(0x9E6C63D0876A9A47 | 1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def steps(column: pa.Array, lower: bool = True, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them) of a text column, about `size` bytes at a time; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if lower:
        column = pc.ascii_lower(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
    del column, data, offsets
    release()


def release() -> None:
    """Gives memory that nothing uses back to the system: workers live on between tasks, and the C library keeps what arrays had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose memory goes back to the system when its task ends."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return over


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, row, first byte, byte after the last) of each word, in order; a word is a run of bytes without SPACES within one row."""
    inside = ~_IS_SPACE[data]
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    edge = np.zeros(len(data) + 1, dtype=bool)  # where a row starts
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(STEP_BYTES) if len(data) <= STEP_BYTES else _powers.__wrapped__(len(data))  # those of a longer text aren't kept
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), rows, starts, ends


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64: n of each."""
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sorted shingle hashes row by row, offsets of rows in them). A row of fewer than k words has its whole sequence as one; one without words has none."""
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    odd = seeds(k, 17) | np.uint64(1)
    n = max(len(hashes) - k + 1, 0)
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k if n else 0):
        grams += mix(hashes[j : j + n] + np.uint64(j)) * odd[j]
    grams = mix(grams)
    out, sizes = [], np.zeros(n_rows, dtype=np.int64)
    for r in range(n_rows):
        low, high = ends[r] - counts[r], ends[r]
        if counts[r] >= k:
            own = np.sort(grams[low : high - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif counts[r]:
            own = np.zeros(1, dtype=np.uint64)
            for j in range(counts[r]):
                own += mix(hashes[low + j : low + j + 1] + np.uint64(j)) * odd[j]
            own = mix(own + np.uint64(counts[r]))
        else:
            continue
        out.append(own)
        sizes[r] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.concatenate(([0], np.cumsum(sizes)))

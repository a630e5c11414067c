"""Words and hashes of whole Arrow text columns as numpy arrays, about a megabyte of text at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A worker's arrays are many times a block, and two workers share an executor with its JVM.
BLOCK_BYTES = 1 << 20

_ONE = np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_batches(spark) -> None:
    """Arrow batches of fewer rows, since rows are whole texts and a batch is held several times over.

    Only Spark's default is changed; a session's own setting stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy_batches(run):
    """``run`` for mapInArrow, giving free memory back at its end: workers stay, and an executor has several."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return tidied


def tidy_table(run):
    """The same for a function of a group's table."""
    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()
    return tidied


def tidy_tables(run):
    """The same for a function of the two tables of a group."""
    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()
    return tidied


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Word characters by UTF-8 byte: all but space and \t..\r; and digits, a-z and every byte above ASCII.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal spans have equal hashes wherever they stand."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


_SHINGLE_CODE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | _ONE


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a shorter text is one shingle."""
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j:j + len(rolled)] * _SHINGLE_CODE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            h = np.sort(rolled[a:b - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif b > a:
            short = (words[a:b] * _SHINGLE_CODE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bag_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signed 64-bit identity of each bag of hashes, whatever their order; ``first`` has where each bag begins."""
    total = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(hashes, out=total[0, 1:])
    np.cumsum(mix(hashes ^ np.uint64(_BASE)), out=total[1, 1:])
    sums = total[:, first[1:]] - total[:, first[:-1]]
    x = mix(sums[0] * _SHINGLE_CODE[0]) + mix(sums[1] * _SHINGLE_CODE[1]) * _SHINGLE_CODE[2] + np.diff(first).astype(np.uint64) * _SHINGLE_CODE[3]
    return mix(x).view(np.int64)


def ragged(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values, kind))

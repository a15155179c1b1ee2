"""Arrow text columns as flat byte arrays: words, hashes and per-row counts without Python objects per word.

A text column is walked in blocks of about ``BLOCK_BYTES`` (whole texts; a longer text is a block of its own), so a
task's memory follows the block, not the partition. Words are ``[^\\x20\\x09-\\x0D]+``; in UTF-8 these separators are
single bytes that occur nowhere else, so words of bytes are words of characters. Hashes are 64-bit polynomials of
substituted bytes with a final mix that takes in the length. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64 arrays."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64) * U64(0xD1342543DE82EF95) + U64(77))
#: Odd multipliers of the words of an n-gram, by position.
PLACES = mix(np.arange(64, dtype=U64) + U64(1_000_003)) | U64(1)
_STEP = 1 << 18
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to ``_STEP``. A worker keeps these tables, so they don't follow its blocks:
    a further power is the product of one of them and one of the few powers of whole steps."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(_STEP + 1, base & _MASK, U64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


class SpanHash:
    """Hashes of byte spans of one array: equal spans have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables()
        self._sum = np.zeros(len(data) + 1, U64)
        for lo in range(0, len(data), _STEP):  # in steps: no further arrays as long as the block
            part = self._sum[lo + 1 : lo + _STEP + 1]
            np.cumsum(_BYTE[data[lo : lo + _STEP]] * up[: len(part)], out=part)
            if lo:
                part *= U64(pow(_BASE, lo, 1 << 64))
                part += self._sum[lo]
        self._far = np.array([pow(_BASE, -lo, 1 << 64) for lo in range(0, len(data) + 1, _STEP)], U64) if len(data) > _STEP else None

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = self._down[start] if self._far is None else self._down[start & (_STEP - 1)] * self._far[start // _STEP]
        return mix((self._sum[end] - self._sum[start]) * down + (end - start).astype(U64))


def blocks(column, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them), block by block."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if large else pa.binary())  # the same bytes, not a copy
    column = pc.fill_null(column, b"") if column.null_count else column
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_pieces(column, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """As ``blocks``, but a text longer than ``max_bytes`` comes in pieces cut before a separator; and whether its end is reached."""
    for lo, hi, data, offsets in blocks(column, max_bytes):
        at = 0
        while len(data) - at > max_bytes:
            end = at + max_bytes
            while end < len(data) and not _SEPARATOR[data[end : end + max_bytes]].any():
                end += max_bytes
            if end >= len(data):
                break
            end += int(_SEPARATOR[data[end : end + max_bytes]].argmax())
            yield lo, hi, data[at:end], np.array([0, end - at]), False
            at = end
        yield lo, hi, data[at:], offsets if not at else np.array([0, len(data) - at]), True


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run):
    """A mapInArrow function whose worker gives freed memory back to the system after each batch and at its end.

    Workers are used again by later stages, which would otherwise start with what the C library kept of the last one."""
    def wrapped(batches):
        def one_by_one():
            for batch in batches:
                yield batch
                del batch
                _give_back()

        yield from run(one_by_one())
        _give_back()

    return wrapped


def trimmed_group(run):
    """The same for an applyInArrow function of one table."""
    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        del table
        _give_back()
        return out

    return wrapped


def trimmed_cogroup(run):
    """The same for an applyInArrow function of two tables."""
    def wrapped(one: pa.Table, two: pa.Table) -> pa.Table:
        out = run(one, two)
        del one, two
        _give_back()
        return out

    return wrapped


@contextmanager
def small_batches(spark, rows: int = 2000):
    """Arrow batches of at most ``rows`` rows for jobs that run inside, as rows that hold whole sets are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class Words:
    """The words of a block, in order: their row in the block, byte span and hash."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of all rows of a block; ``lower`` folds A-Z first."""
    if lower:
        data = _LOWER[data]
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its row
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, row, start, end, SpanHash(data)(start, end))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each row's bytes are flagged."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every n consecutive words of one row."""
    if len(w.hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(w.row[n - 1 :] == w.row[: len(w.row) - n + 1])
    total = np.zeros(len(at), U64)
    for k in range(n):
        total += w.hash[at + k] * PLACES[k]
    return at, mix(total)


def with_row(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit key of (row, value)."""
    return mix(value ^ mix(row.astype(U64) + U64(0x51ED27)))


def shingle_sets(w: Words, n_rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-word shingles of each row, by row; a row of fewer words has its whole sequence as one."""
    at, value = ngrams(w, n)
    row = w.row[at]
    count = np.bincount(w.row, minlength=n_rows) if len(w.row) else np.zeros(n_rows, np.int64)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            total = np.full(len(short), k, U64)
            for j in range(k):
                total += w.hash[begin[short] + j] * PLACES[j]
            row, value = np.concatenate((row, short)), np.concatenate((value, mix(total + U64(0xABCDEF))))
    if not len(row):
        return row.astype(np.int64), value
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]

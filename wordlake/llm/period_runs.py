"""Operator 13, periodic run detection by block convolution.

A run is a stretch of consecutive words whose smallest period is q, of at least ``max(24, 3 * q)`` words, that no
neighbouring word extends. At each dyadic scale B (8, 16, 32, ...) the words are cut into blocks of B, and every block is
looked for at the distances B to 2 B - 1 (1 to 15 at the first scale) behind it: a run of period q holds at least 2 q
positions whose word comes again q words later, so at the scale with B <= q < 2 B one whole block lies among them.

The sums of squared differences of a block and its following window come from one cyclic convolution, a number
theoretic transform modulo a prime. Words stand there as fixed pseudo-random residues; all arithmetic is exact, so the
sum is 0 wherever the block occurs, and where it is 0 by chance the word comparison of the next step finds out. The
distances seed extensions to both sides, word by word. A seed inside a run of a period that divides its distance is
that run again and is not extended.

A block that holds a word without another one less than 2 B words on can't occur in its window and isn't transformed
(the gaps are known from one sort). Rows are worked through a megabyte of text at a time in a task, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wordlake.llm.textblocks import U64, blocks, mix, trimmed, with_row, words

MIN_LENGTH = 24
MIN_EXPONENT = 3
BASE = 8
BLOCK = 1 << 20
#: 15 * 2 ** 27 + 1 and a generator of its units (fixed values); transforms may be 2 ** 27 long.
PRIME, GENERATOR = 2013265921, 31
#: Elements of one batch of transforms.
_CELLS = 1 << 18
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity of order ``size`` (or of its inverse)."""
    if (size, inverse) not in _roots:
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        if inverse:
            root = pow(root, -1, PRIME)
        out = np.ones(max(1, size // 2), U64)
        n = 1
        while n < len(out):  # doubling: the next n powers are the first n times root ** n
            out[n : 2 * n] = out[:n] * U64(pow(root, n, PRIME)) % U64(PRIME)
            n *= 2
        _roots[size, inverse] = out
    return _roots[size, inverse]


def _forward(x: np.ndarray) -> np.ndarray:
    """Transforms of the rows of x (values below PRIME), in bit-reversed order."""
    rows, size = x.shape
    half = size // 2
    while half:
        pairs = x.reshape(rows, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = (low + high) % U64(PRIME)
        out[:, :, 1] = (low + U64(PRIME) - high) * _powers(2 * half, False) % U64(PRIME)
        x = out.reshape(rows, size)
        half //= 2
    return x


def _backward(x: np.ndarray) -> np.ndarray:
    """The inverse of ``_forward``."""
    rows, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(rows, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1] * _powers(2 * half, True) % U64(PRIME)
        out = np.empty_like(pairs)
        out[:, :, 0] = (low + high) % U64(PRIME)
        out[:, :, 1] = (low + U64(PRIME) - high) % U64(PRIME)
        x = out.reshape(rows, size)
        half *= 2
    return x * U64(pow(size, -1, PRIME)) % U64(PRIME)


def occurrences(value: np.ndarray, at: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) wherever the squared differences of ``value[start:start + size]`` and the words
    ``distance`` further sum to 0 modulo PRIME, for block starts ``at`` and distances from ``least`` to 2 * size - 1."""
    starts, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    length = 4 * size
    padded = np.concatenate((value, np.zeros(3 * size, U64)))
    offset = np.arange(3 * size - 1)
    step = max(1, _CELLS // length)
    for lo in range(0, len(at), step):
        begin = at[lo : lo + step]
        window = np.zeros((len(begin), length), U64)
        window[:, : 3 * size - 1] = padded[begin[:, None] + offset]
        block = np.zeros((len(begin), length), U64)
        block[:, :size] = window[:, size - 1 :: -1] if size > 1 else window[:, :1]
        square = window * window % U64(PRIME)
        total = np.zeros((len(begin), length + 1), U64)
        np.cumsum(square, axis=1, out=total[:, 1:])  # at most 2 ** 27 values below 2 ** 31
        cross = _backward(_forward(window) * _forward(block) % U64(PRIME))
        d = np.arange(least, 2 * size)
        own = (total[:, size] - total[:, 0])[:, None] % U64(PRIME)
        there = (total[:, least + size : 3 * size] - total[:, least : 2 * size]) % U64(PRIME)
        both = U64(2) * cross[:, d + size - 1] % U64(PRIME)
        row, column = np.nonzero((own + there) % U64(PRIME) == both)
        starts.append(begin[row])
        distances.append(d[column])
    start, distance = np.concatenate(starts), np.concatenate(distances)
    inside = start + distance + size <= len(value)
    return start[inside], distance[inside]


def _agreement(a: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    n, step, most = 0, 32, len(a) - j
    while n < most:
        m = min(step, most - n)
        differ = a[i + n : i + n + m] != a[j + n : j + n + m]
        if differ.any():
            return n + int(differ.argmax())
        n += m
        step *= 2
    return n


def _agreement_before(a: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j (i < j)."""
    n, step = 0, 32
    while n < i:
        m = min(step, i - n)
        differ = a[i - n - m : i - n] != a[j - n - m : j - n]
        if differ.any():
            return n + int(differ[::-1].argmax())
        n += m
        step *= 2
    return n


class _Runs:
    """Runs found so far, by period; those of one period have rising starts and rising ends."""

    def __init__(self):
        self.by_period: dict[int, list[tuple[int, int]]] = {}

    def holds(self, start: np.ndarray, end: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Which stretches lie inside a run whose period divides their distance."""
        held = np.zeros(len(start), bool)
        for period, spans in self.by_period.items():
            fits = np.flatnonzero((distance % period == 0) & ~held)
            if len(fits):
                ends = np.array(spans)
                k = np.searchsorted(ends[:, 0], start[fits], "right") - 1
                held[fits] = (k >= 0) & (ends[k, 1] >= end[fits])
        return held

    def add(self, period: int, spans: list[tuple[int, int]]) -> None:
        if spans:
            self.by_period[period] = sorted({*self.by_period.get(period, []), *spans})


def find_runs(code: np.ndarray, longest: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs among word codes, by start and period.

    Several rows may stand one behind the other if equal codes never meet from two rows; ``longest`` is the number of
    words of the longest one. ``min_exponent`` is at least 3 and ``min_length`` at least 24: shorter runs may lack a block.
    """
    none = np.zeros(0, np.int64)
    n = len(code)
    if n < min_length:
        return none, none, none
    order = np.argsort(code, kind="stable")
    gap = np.full(n, n, np.int64)
    same = code[order[1:]] == code[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    number = np.empty(n, np.int32)
    number[order] = np.concatenate(([0], np.cumsum(~same)))
    value = mix(code) % U64(PRIME)
    found = _Runs()
    size, widest = BASE, gap[: n // BASE * BASE].reshape(-1, BASE).max(axis=1)
    while size == BASE or size <= longest // min_exponent:
        least = 1 if size == BASE else size
        at = np.flatnonzero(widest < 2 * size) * size
        start, distance = occurrences(value, at, size, least)
        left = ~found.holds(start, start + distance + size, distance)
        start, distance = start[left], distance[left]
        by = np.lexsort((start, distance))
        start, distance = start[by], distance[by]
        for d in np.unique(distance).tolist():
            seeds = start[np.searchsorted(distance, d) : np.searchsorted(distance, d, "right")]
            if size == BASE:  # a period found at this scale may divide this one
                seeds = seeds[~found.holds(seeds, seeds + d + size, np.full(len(seeds), d))]
            spans, k = [], 0
            while k < len(seeds):
                i = int(seeds[k])
                after = _agreement(number, i, i + d)
                if after:
                    begin, end = i - _agreement_before(number, i, i + d), i + d + after
                    if end - begin >= max(min_length, min_exponent * d):
                        spans.append((begin, end))
                k = max(k + 1, int(np.searchsorted(seeds, i + after)))
            found.add(d, spans)
        size *= 2
        even = len(widest) // 2
        widest = widest[: 2 * even].reshape(-1, 2).max(axis=1) if even else widest[:0]
    first: dict[tuple[int, int], int] = {}
    for period in sorted(found.by_period):
        for span in found.by_period[period]:
            first.setdefault(span, period)
    out = np.array(sorted((s, q, e) for (s, e), q in first.items()), np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans of each row joined by one space: bytes and the rows' offsets in them."""
    size = end - start
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    place = np.cumsum(size + ~first) - size  # where each span begins
    out = np.full(int(place[-1] + size[-1]) if len(size) else 0, 0x20, np.uint8)
    if len(size):
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[inner + np.repeat(place, size)] = data[inner + np.repeat(start, size)]
    held = np.zeros(n_rows, np.int64)
    np.add.at(held, row, size + ~first)
    return out, np.concatenate(([0], np.cumsum(held)))


def _batches(source: Iterator[pa.RecordBatch], schema: pa.Schema, min_length: int, min_exponent: int) -> Iterator[pa.RecordBatch]:
    kind = schema.field("runs").type.value_type
    for batch in source:
        for lo, hi, data, offsets in blocks(batch.column("text"), BLOCK):
            w = words(data, offsets)
            n = np.bincount(w.row, minlength=hi - lo)
            begin = np.concatenate(([0], np.cumsum(n)))
            start, end, period = find_runs(with_row(w.row, w.hash), int(n.max(initial=0)), min_length, min_exponent)
            row = np.searchsorted(begin, start, "right") - 1
            marks = np.zeros(len(w.row) + 1, np.int64)  # a run covers start + period to end
            np.add.at(marks, start + period, 1)
            np.add.at(marks, end, -1)
            kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
            text, ends = _joined(data, w.start[kept], w.end[kept], w.row[kept], hi - lo)
            runs = pa.StructArray.from_arrays([pa.array(start - begin[row]), pa.array(end - start), pa.array(period)], fields=list(kind))
            per_row = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo))))
            collapsed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), runs).cast(schema.field("runs").type),
                collapsed.cast(pa.binary())], schema=schema)


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed.

    ``collapsed`` has the UTF-8 bytes of the words that no run covers after its first period, joined by one space. Words
    are ``[^\\x20\\x09-\\x0D]+``, told apart by 64-bit hashes; a null or empty text has none and an empty ``collapsed``.
    Rows are independent, so null and repeated ids and equal rows are kept as they are; extra columns are not read. A
    text longer than a block is worked through whole, with about 100 bytes of arrays a word.
    """
    if min_exponent < MIN_EXPONENT or min_length < MIN_LENGTH:
        raise ValueError(f"runs are found from exponent {MIN_EXPONENT} and length {MIN_LENGTH} on")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run = pa.struct([pa.field(c, pa.int64()) for c in ("start", "length", "period")])
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.binary())])
    return rows.mapInArrow(trimmed(lambda source: _batches(source, schema, min_length, min_exponent)),
                           f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")

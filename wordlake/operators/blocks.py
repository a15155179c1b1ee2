"""Symbols of long arrays looked up in a table without a row for each place.

Rows are taken together in blocks of about ``BLOCK`` symbols. A block's symbols are numbered, so a row holds small
integers, and only the block's distinct symbols, listed in its first row, meet the table in a join. What is found goes
back to the block by its number. The table is never collected, and a common symbol is one row of a block in the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.session import cut_lineage

#: Symbols of a block, about.
BLOCK = 1 << 20


def cuts(length: np.ndarray, size: int):
    """(first row, row after the last, symbols before, symbols up to the end) of whole rows of about ``size`` symbols."""
    ends = np.cumsum(length)
    lo = 0
    while lo < len(length):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, "right")))
        yield lo, hi, before, int(ends[hi - 1])
        lo = hi


def listed(length, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), values)


def first_of(rows: int, words: pa.Array) -> pa.ListArray:
    """``words`` in the first of ``rows`` rows, nothing in the others."""
    return listed(np.append(len(words), np.zeros(rows - 1, np.int64)), words)


def fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def coded(df: DataFrame, keys: list[str], arr_col: str) -> DataFrame:
    """(keys..., block, codes, words) of every row, written once: ``codes`` numbers the row's symbols (-1: null) by the
    ``words`` in the first row of its block."""
    kind, names = df.schema[arr_col].dataType.elementType.simpleString(), [*keys, "block", "codes", "words"]

    def numbered(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            arrays = batch.column(len(keys))
            length = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy().astype(np.int64)
            values = arrays.flatten()
            for lo, hi, start, stop in cuts(length, BLOCK):
                found = values.slice(start, stop - start).dictionary_encode()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(len(keys))), pa.array(np.full(hi - lo, block)),
                     listed(length[lo:hi], pc.fill_null(found.indices, -1)), first_of(hi - lo, found.dictionary)], names=names)
                block += 1

    return cut_lineage(df.select(*keys, arr_col).mapInArrow(numbered, f"{fields(df, keys)}{', ' if keys else ''}block long, codes array<int>, words array<{kind}>"))


def found(blocks: DataFrame, table: DataFrame, symbol_col: str) -> DataFrame:
    """(of_block, at, ...): the rows of ``table`` for the symbols of each block, numbered as in its codes."""
    words = blocks.where(F.size("words") > 0).select(F.col("block").alias("of_block"), F.posexplode("words").alias("at", symbol_col))
    return words.join(table, symbol_col).drop(symbol_col)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of more than one row of ``df``, written once."""
    return cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys))

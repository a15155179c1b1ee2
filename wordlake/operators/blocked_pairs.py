"""Co-occurrence sums of numbered words in blocks of packed cells.

Words are numbered once over the whole table, so a partial sum of a chunk is a cell of 5 bytes (two places and a small
count) in a piece of its block of the matrix, not a row of two strings. Pieces of a block are added up where they meet.
Words come back there: a block needs the words of its rows and of its columns, lists of at most 65 536.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.operators import cooccur as co
from wordlake.operators import corpus_windows as cw
from wordlake.operators import sparse as sp
from wordlake.operators import vocab as vb
from wordlake.operators.ordering import global_index
from wordlake.session import cut_lineage

#: Pairs of places that a block of the matrix stands for, about.
BLOCK_PAIRS = 1 << 21
_CELLS = "row_word string, col_word string, weight double"


def numbered(rows: DataFrame, arr_col: str, keys: list[str]) -> tuple[DataFrame, DataFrame, int, int]:
    """(rows (keys..., ids), words (symbol, idx), their number, number of tokens); ``keys`` name each row, nulls are left out."""
    found = vb.frequencies(rows.select(F.explode(arr_col).alias("token")).where("token is not null"))
    words = cut_lineage(global_index(found, [F.asc("symbol")]))
    size, tokens = words.agg(F.count("*"), F.sum("freq")).first()
    return vb.encode_rows(rows, arr_col, words, "ids", None, keys), words.select("symbol", "idx"), size, tokens or 0


def block_count(size: int, pairs: int) -> int:
    return max(1, -(-size // sp.BLOCK_ROWS), math.ceil(math.sqrt(pairs / BLOCK_PAIRS)))


def pieces(rows: DataFrame, ids_col: str, window: int, blocks: int, skip_equal: bool, both_ways: bool = False) -> DataFrame:
    """Partial sums of the pairs at most ``window`` apart in the rows, as pieces: cells (greater, lesser), or with
    ``both_ways`` those and their transpose."""
    def cut(batches):
        return sp.cut(co.mirrored(batches) if both_ways else batches, blocks)

    return co.pairs(rows, ids_col, window, None, skip_equal, unordered=True, then=cut, schema=sp.PIECE)


def matrix(parts: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """(row_word, col_word, weight): the sums of the pieces and of their transpose."""
    names = words.select((F.col("idx") % blocks).cast("int").alias("block"), F.struct(F.floor(F.col("idx") / blocks).alias("at"), "symbol").alias("word"))
    names = names.groupBy("block").agg(F.transform(F.array_sort(F.collect_list("word")), lambda x: x["symbol"]).alias("words"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sides = names.select(F.col("block").alias("i"), every.alias("j"), F.lit(0).alias("side"), "words").unionByName(
        names.select(every.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "words"))

    def added(mine: pa.Table, held: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"row_word": pa.array([], pa.string()), "col_word": pa.array([], pa.string()), "weight": pa.array([], pa.float64())})
        at, col, w = sp.summed([sp.arrays(*x) for x in zip(*(mine.column(c).to_pylist() for c in ("at", "col", "w")))])
        lists = dict(zip(held.column("side").to_pylist(), held.column("words").combine_chunks()))
        one, two = lists[0].values.take(pa.array(at)), lists[1].values.take(pa.array(col))
        same = (at == col) & (mine.column("i")[0].as_py() == mine.column("j")[0].as_py())
        apart = pa.array(~same)
        return pa.table({"row_word": pa.concat_arrays([one, two.filter(apart)]), "col_word": pa.concat_arrays([two, one.filter(apart)]),
                         "weight": np.concatenate((np.where(same, 2 * w, w), w[~same]))})

    return parts.groupBy("i", "j").cogroup(sides.groupBy("i", "j")).applyInArrow(added, _CELLS)


def two_sided(rows: DataFrame, arr_col: str, window: int, skip_equal: bool = True) -> DataFrame:
    """C2 / C3 of the words in each row of ``rows``."""
    ids, words, size, tokens = numbered(rows.select(F.monotonically_increasing_id().alias("row"), arr_col), arr_col, ["row"])
    blocks = block_count(size, tokens * window)
    return matrix(pieces(ids, "ids", window, blocks, skip_equal), words, blocks)


def stream_two_sided(rows: DataFrame, arr_col: str, order_cols: list[str], window: int, skip_equal: bool = True) -> DataFrame:
    """C2 / C3 of all words as one stream in the order of ``order_cols``, windows reach over rows."""
    rows = rows.select(F.struct(*order_cols).alias("at"), F.monotonically_increasing_id().alias("row"), arr_col)
    ids, words, size, tokens = numbered(rows, arr_col, ["at", "row"])
    blocks = block_count(size, tokens * window)
    segments = cut_lineage(ids.where(F.size("ids") > 0).select(F.lit(0).alias("stream"), "at", F.col("ids").alias("tokens")))
    over = cw.crossing_pairs(segments, window).select(F.greatest("row", "col").alias("row"), F.least("row", "col").alias("col"), "w")
    if skip_equal:
        over = over.where(F.col("row") != F.col("col"))
    over = over.mapInArrow(lambda batches: sp.cut(batches, blocks), sp.PIECE)
    return matrix(pieces(segments, "tokens", window, blocks, skip_equal).unionByName(over), words, blocks)

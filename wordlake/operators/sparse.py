"""Sparse square matrices of any width times a few dense columns, in blocks.

Rows and columns are numbered from 0. Number x lies in block x % blocks at place x // blocks. The cells of a row block and a
column block are one packed piece of small integers (5 bytes a cell while counts are below 256). Pieces are
partitioned by column block and persisted once, so a product moves no cell: the dense rows come to their pieces, block by
block, each task adds up the products of its pieces per row block, and only the rows of these sums that it touched are
exchanged. There are about as many tasks as cores, so what moves is at most the dense rows once a core, however many cells
there are. A hot word's column is one place of a block, and its row is spread over all column blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.session import cut_lineage, free_unused

#: Rows of a block at most (a place has 16 bits), cells packed at a time, cells multiplied at a time.
BLOCK_ROWS, CELLS, STEP = 1 << 16, 1 << 21, 1 << 16
PIECE = "i int, j int, at binary, col binary, w binary"
_WEIGHTS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64}


def block_count(size: int, tasks: int) -> int:
    return max(1, 4 * tasks, -(-size // BLOCK_ROWS))


def rows_of(block: int, blocks: int, size: int) -> int:
    return max(0, -(-(size - block) // blocks))


def _small(w: np.ndarray) -> np.ndarray:
    """The weights in the least type that holds them as they are."""
    if len(w) and (w == np.floor(w)).all() and w.min() >= 0 and w.max() < 1 << 32:
        return w.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if w.max() <= np.iinfo(t).max))
    return w.astype(np.float64)


def arrays(at: bytes, col: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(at) // 2
    return np.frombuffer(at, np.uint16), np.frombuffer(col, np.uint16), np.frombuffer(w, _WEIGHTS[len(w) // n])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    i, j, at, col, w = zip(*((i, j, at.tobytes(), col.tobytes(), _small(w).tobytes()) for i, j, at, col, w in rows), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(x, pa.binary()) for x in (at, col, w))],
                                      names=["i", "j", "at", "col", "w"])


def _cut(batches: list[pa.RecordBatch], blocks: int) -> pa.RecordBatch:
    r, c, w = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(3))
    key = (r % blocks * blocks + c % blocks) << 16 | r // blocks
    order = np.argsort(key)
    key, col, w = key[order], (c[order] // blocks).astype(np.uint16), w[order]
    piece = key >> 16
    first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    at = (key & 0xFFFF).astype(np.uint16)
    ends = np.append(first[1:], len(key))
    return _pieces([(int(piece[lo]) // blocks, int(piece[lo]) % blocks, at[lo:hi], col[lo:hi], w[lo:hi]) for lo, hi in zip(first, ends, strict=True)])


def cut(batches, blocks: int):
    """Pieces of batches (row, column, weight), some batches at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CELLS:
            yield _cut(held, blocks)
            held, n = [], 0
    if n:
        yield _cut(held, blocks)


def summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, column, weight) of the cells of one block, each once, in order."""
    at, col, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = at.astype(np.int64) << 16 | col
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    total = np.add.reduceat(w[order].astype(np.float64), first) if len(first) else w.astype(np.float64)
    return key[first] >> 16, key[first] & 0xFFFF, total


def packed(triples: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """Pieces (i, j, at, col, w) of (row, column, weight) in this order of columns, partitioned by ``j`` and in the order
    of ``i``; persisted."""
    return gathered(triples.mapInArrow(lambda batches: cut(batches, blocks), PIECE), tasks)


def gathered(pieces: DataFrame, tasks: int) -> DataFrame:
    """Pieces with few equal cells, partitioned by ``j`` and in the order of ``i``; written once, so that nothing of the
    pieces they come from stays, and persisted."""
    def one(place: tuple, parts: list[tuple]) -> pa.RecordBatch:
        at, col, w = summed(parts)
        return _pieces([(*place, at.astype(np.uint16), col.astype(np.uint16), w)])

    def merged(batches):
        place, parts, n = None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if parts and ((r["i"], r["j"]) != place or n >= CELLS):
                    yield one(place, parts)
                    parts, n = [], 0
                place = r["i"], r["j"]
                parts.append(arrays(r["at"], r["col"], r["w"]))
                n += len(parts[-1][0])
        if parts:
            yield one(place, parts)

    small = cut_lineage(pieces.repartition(tasks, "j").sortWithinPartitions("i", "j").mapInArrow(merged, PIECE))
    free_unused(small.sparkSession)
    return small.repartition(tasks, "j").sortWithinPartitions("i", "j").persist(StorageLevel.MEMORY_AND_DISK)


def with_dense(cells: DataFrame, x: DataFrame, tasks: int) -> DataFrame:
    """Every piece with the dense rows of its columns; these come to where the piece is."""
    dense = x.select(F.col("block").alias("j"), "x").repartition(tasks, "j").hint("shuffle_hash")
    return cells.join(dense, "j").select("i", "at", "col", "w", "x")


def product(cells: DataFrame, x: DataFrame, width: int, blocks: int, size: int, tasks: int) -> DataFrame:
    """(block, x): the matrix of ``cells`` times the dense rows (block, x) with ``width`` columns, written once. A row
    block without cells has no row."""
    def run(batches):
        here, block, total, touched = TaskContext.get().partitionId(), None, None, None

        def sums():
            at = np.flatnonzero(touched)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([here], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                                               pa.array([total[at].tobytes()], pa.binary())], names=["block", "task", "at", "x"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["i"] != block:
                    if block is not None:
                        yield sums()
                    block = r["i"]
                    total, touched = np.zeros((rows_of(block, blocks, size), width)), np.zeros(rows_of(block, blocks, size), bool)
                at, col, w = arrays(r["at"], r["col"], r["w"])
                dense = np.frombuffer(r["x"]).reshape(-1, width)
                for lo in range(0, len(at), STEP):
                    a, b = at[lo : lo + STEP], col[lo : lo + STEP]
                    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                    total[a[first]] += np.add.reduceat(dense[b] * w[lo : lo + STEP, None], first)
                    touched[a[first]] = True
        if block is not None:
            yield sums()

    def added(parts: pa.Table) -> pa.Table:
        block = parts.column("block")[0].as_py()
        total = np.zeros((rows_of(block, blocks, size), width))
        for at in np.argsort(parts.column("task").to_numpy(), kind="stable").tolist():
            rows = np.frombuffer(parts.column("at")[at].as_buffer(), np.uint16)
            total[rows] += np.frombuffer(parts.column("x")[at].as_buffer()).reshape(-1, width)
        return pa.table({"block": pa.array([block], pa.int32()), "x": [total.tobytes()]})

    parts = with_dense(cells, x, tasks).mapInArrow(run, "block int, task int, at binary, x binary")
    return cut_lineage(parts.groupBy("block").applyInArrow(added, "block int, x binary"))


def started(spark, width: int, blocks: int, size: int) -> DataFrame:
    """(block, x): dense rows of mixed numbers from -1 to 1 that depend on the row's number and the column alone."""
    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                number = np.arange(block, size, blocks, dtype=np.uint64)[:, None] * np.uint64(width) + np.arange(1, width + 1, dtype=np.uint64)
                z = number * np.uint64(0x9E3779B97F4A7C15)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([((z ^ z >> np.uint64(31)) / 2.0 ** 63 - 1).tobytes()], pa.binary())],
                                                 names=["block", "x"])

    return spark.range(blocks).mapInArrow(run, "block int, x binary")


def gram(y: DataFrame, width: int) -> np.ndarray:
    """Sum of x^T x over all rows; one small matrix a block comes to the driver."""
    def run(batches):
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("x"), strict=True):
                x = np.frombuffer(x.as_buffer()).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(x.T @ x).tobytes()], pa.binary())], names=["block", "g"])

    parts = sorted(y.mapInArrow(run, "block int, g binary").collect())
    return sum((np.frombuffer(r.g).reshape(width, width) for r in parts), np.zeros((width, width)))


def times(y: DataFrame, b: np.ndarray) -> DataFrame:
    """(block, x): the dense rows times a small matrix."""
    def run(batches):
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("x"), strict=True):
                made = np.frombuffer(x.as_buffer()).reshape(-1, len(b)) @ b
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["block", "x"])

    return y.mapInArrow(run, "block int, x binary")


def listed(y: DataFrame, width: int, blocks: int) -> DataFrame:
    """(row long, vec array<double>) of every dense row."""
    def run(batches):
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("x"), strict=True):
                x = np.frombuffer(x.as_buffer())
                rows = np.arange(len(x) // width, dtype=np.int64) * blocks + block
                vec = pa.FixedSizeListArray.from_arrays(pa.array(x), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(rows), vec], names=["row", "vec"])

    return y.mapInArrow(run, "row long, vec array<double>")

"""Exact nearest-neighbour search with distance bounds.

Rows of the table are put into small blocks around pivots; a block keeps its centre and its radius. No row of a block
is nearer to a query than the centre's distance less the radius (triangle inequality; for dot products
``q.x <= q.c + |q| r``), so a block whose bound lies beyond the k best rows already known is skipped unread.

Two ways, by the counted size of the queries:

* at most ``QUERIES`` query vectors travel to the tasks. Each task forms blocks of its own rows, takes them
  in order of their bounds and keeps the k best rows of each query; no shuffle of the table, no pivots from elsewhere;
* beyond that both sides meet by cell. Pivots are a bounded sample of the table, a query goes only to the cells that the
  bounds leave, and blocks of queries join blocks of rows on the cell.

Either way the k best rows of each task or pair of blocks are merged by a partial top-k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wordlake.operators.relational import top_n_per_group
from wordlake.session import cut_lineage

QUERIES = 4096
#: Rows that a task holds at once, rows of a block, pivots of the second way.
BUFFER, BLOCK, PIVOTS = 16384, 128, 256
METHODS = ("cos", "euclid", "l1")
#: Bounds are computed in floating point; a block is skipped only if it is further away than this beyond the best.
SLACK = 1e-7


def scores(q: np.ndarray, t: np.ndarray, method: str) -> np.ndarray:
    """Dot products, squared Euclidean or L1 distances of all rows of q and t."""
    if method == "cos":
        return q @ t.T
    out = np.empty((len(q), len(t)))
    for lo in range(0, len(q), 64):
        gap = q[lo : lo + 64, None, :] - t[None]
        out[lo : lo + 64] = (gap * gap).sum(axis=2) if method == "euclid" else np.abs(gap).sum(axis=2)
    return out


def _lengths(x: np.ndarray, method: str) -> np.ndarray:
    return np.abs(x).sum(axis=-1) if method == "l1" else np.sqrt((x * x).sum(axis=-1))


def least_ranks(q: np.ndarray, centre: np.ndarray, radius: np.ndarray, method: str) -> np.ndarray:
    """A bound below the rank (smaller is nearer) of any row within ``radius`` of ``centre``, for all queries and centres."""
    s = scores(q, centre, method)
    if method == "cos":
        return -(s + _lengths(q, method)[:, None] * radius) - SLACK
    near = np.maximum((np.sqrt(s) if method == "euclid" else s) - radius - SLACK, 0)
    return near * near if method == "euclid" else near


def most_ranks(q: np.ndarray, centre: np.ndarray, radius: np.ndarray, method: str) -> np.ndarray:
    """A bound above the rank of any row within ``radius`` of ``centre``."""
    s = scores(q, centre, method)
    if method == "cos":
        return -(s - _lengths(q, method)[:, None] * radius) + SLACK
    far = (np.sqrt(s) if method == "euclid" else s) + radius + SLACK
    return far * far if method == "euclid" else far


def cut_blocks(t: np.ndarray, pivots: np.ndarray, size: int = BLOCK) -> list[tuple[int, np.ndarray]]:
    """(pivot, row numbers) of blocks of at most ``size`` rows, each around its nearest pivot."""
    near = np.empty(len(t), np.int64)
    length = (pivots * pivots).sum(axis=1)
    for lo in range(0, len(t), 4096):
        near[lo : lo + 4096] = (length - 2 * (t[lo : lo + 4096] @ pivots.T)).argmin(axis=1)
    order = np.argsort(near, kind="stable")
    out = []
    for cell in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
        out += [(int(near[cell[0]]), cell[lo : lo + size]) for lo in range(0, len(cell), size)]
    return out


class Best:
    """The k rows of least (rank, row number) of each query, among the rows offered."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rank, self.row = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.score = np.full((n, k), np.nan)

    def offer(self, some: np.ndarray, score: np.ndarray, rank: np.ndarray, row: np.ndarray) -> None:
        ranks = np.concatenate((self.rank[some], rank), axis=1)
        rows = np.concatenate((self.row[some], np.broadcast_to(row, rank.shape)), axis=1)
        values = np.concatenate((self.score[some], score), axis=1)
        first = np.lexsort((rows, ranks), axis=1)[:, : self.k]
        pick = lambda a: np.take_along_axis(a, first, axis=1)
        self.rank[some], self.row[some], self.score[some] = pick(ranks), pick(rows), pick(values)


def search_rows(q: np.ndarray, t: np.ndarray, k: int, method: str, digits: int, limit: np.ndarray | None = None) -> tuple[Best, int, int]:
    """The k best of the rows t (in key order) for each query, and how many (query, block) pairs there were and were
    skipped. ``limit``: ranks beyond which a row is of no use."""
    step = max(1, len(t) // int(max(1, np.sqrt(len(t)))))
    blocks = [rows for _, rows in cut_blocks(t, t[::step])]
    centre = np.array([t[rows].mean(axis=0) for rows in blocks])
    radius = np.array([_lengths(t[rows] - c, method).max() for rows, c in zip(blocks, centre)])
    low = least_ranks(q, centre, radius, method)
    best, skipped = Best(len(q), k), 0
    limit = np.full(len(q), np.inf) if limit is None else limit
    for b in np.argsort(low.min(axis=0), kind="stable"):
        some = np.flatnonzero(low[:, b] <= np.minimum(best.rank[:, -1], limit) + 10.0 ** -digits)
        skipped += len(q) - len(some)
        if len(some):
            rows = np.sort(blocks[b])
            score = scores(q[some], t[rows], method)
            best.offer(some, score, np.round(-score if method == "cos" else score, digits), rows)
    return best, len(q) * len(blocks), skipped


def _vectors(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _clean(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("key"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())


def _found(best: Best, qid: pa.Array, keys: pa.Array, limit: np.ndarray | None = None) -> pa.RecordBatch:
    held = np.isfinite(best.rank)
    if limit is not None:
        held &= best.rank <= limit[:, None]
    query, place = np.nonzero(held)
    return pa.RecordBatch.from_arrays([qid.take(pa.array(query)), keys.take(pa.array(best.row[query, place])), pa.array(best.score[query, place]),
                                       pa.array(best.rank[query, place])], names=["qid", "key", "score", "rank"])


def _few(q_rows: list, dim: int, q_type: pa.DataType, table: DataFrame, k: int, method: str, digits: int, counter, schema: str) -> DataFrame:
    q = np.array([r["vec"] for r in q_rows], np.float64).reshape(-1, dim)
    sent = table.sparkSession.sparkContext.broadcast((pa.array([r["key"] for r in q_rows], q_type), q))

    def run(batches):
        qid, q = sent.value
        limit = np.full(len(q), np.inf)

        def flush(held):
            nonlocal limit
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.take(pc.sort_indices(rows.column("key")))
            best, pairs, skipped = search_rows(q, _vectors(rows.column("vec").combine_chunks(), dim), k, method, digits, limit)
            if counter is not None:
                counter.add(np.array([pairs, skipped]))
            out = _found(best, qid, rows.column("key").combine_chunks(), limit)
            limit = np.minimum(limit, best.rank[:, -1])
            return out

        held, n = [], 0
        for batch in batches if len(q) else ():
            held.append(batch)
            n += batch.num_rows
            if n >= BUFFER:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return table.mapInArrow(run, schema)


def _many(queries: DataFrame, dim: int, table: DataFrame, k: int, method: str, digits: int, counter, schema: str) -> DataFrame:
    t_kind, q_kind = table.schema["key"].dataType.simpleString(), queries.schema["key"].dataType.simpleString()
    sample = table.select("vec", F.xxhash64("key", F.lit(5)).alias("h")).orderBy("h").limit(PIVOTS).collect()
    pivots = np.array([r["vec"] for r in sample]).reshape(-1, dim)

    def grouped(batches):
        for batch in batches:
            t, keys = _vectors(batch.column("vec"), dim), batch.column("key")
            for cell, rows in cut_blocks(t, pivots):
                far = _lengths(t[rows] - pivots[cell], method).max()
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([float(far)]), pa.array([len(rows)], pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), keys.take(pa.array(rows))),
                                                  pa.array([t[rows].tobytes()])], names=["cell", "radius", "n", "t_keys", "t_vecs"])

    blocks = cut_lineage(table.mapInArrow(grouped, f"cell int, radius double, n long, t_keys array<{t_kind}>, t_vecs binary"))
    cells = sorted(blocks.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect())  # at most PIVOTS rows
    name, radius, held = (np.array([r[c] for r in cells]) for c in ("cell", "radius", "n"))
    centre = pivots[name.astype(np.int64)] if len(cells) else pivots[:0]

    def placed(batches):
        for batch in batches:
            q, keys = _vectors(batch.column("vec"), dim), batch.column("key")
            if not len(cells) or not len(q):
                continue
            high = most_ranks(q, centre, radius, method)
            order = np.argsort(high, axis=1)
            enough = (np.cumsum(held[order], axis=1) >= k).argmax(axis=1)  # the cells up to here hold k rows
            all_held = held.sum() >= k
            limit = np.take_along_axis(high, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0] if all_held else np.full(len(q), np.inf)
            meet = least_ranks(q, centre, radius, method) <= limit[:, None] + 10.0 ** -digits
            if counter is not None:
                counter.add(np.array([meet.size, meet.size - int(meet.sum())]))
            for c in range(len(cells)):
                rows = np.flatnonzero(meet[:, c])
                for lo in range(0, len(rows), 1024):
                    some = rows[lo : lo + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([int(name[c])], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), keys.take(pa.array(some))),
                                                      pa.array([q[some].tobytes()])], names=["cell", "q_keys", "q_vecs"])

    sent = queries.mapInArrow(placed, f"cell int, q_keys array<{q_kind}>, q_vecs binary")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q = np.frombuffer(batch.column("q_vecs")[i].as_py()).reshape(-1, dim)
                t = np.frombuffer(batch.column("t_vecs")[i].as_py()).reshape(-1, dim)
                keys = batch.column("t_keys")[i].values
                order = pc.sort_indices(keys)
                score = scores(q, t[order.to_numpy()], method)
                best = Best(len(q), k)
                best.offer(np.arange(len(q)), score, np.round(-score if method == "cos" else score, digits), np.arange(len(t)))
                yield _found(best, batch.column("q_keys")[i].values, keys.take(order))

    return blocks.select("cell", "t_keys", "t_vecs").join(sent, "cell").mapInArrow(run, schema)


def nearest(queries: DataFrame, table: DataFrame, k: int = 10, method: str = "cos", query_key: str = "qid", table_key: str = "word",
            tie_digits: int = 9, counter=None) -> DataFrame:
    """The k nearest rows of ``table`` for each query vector: (qid, key, score, rank from 1).

    ``cos``: dot product (vectors assumed normalized), descending; ``euclid``: squared distance, ascending; ``l1``: L1
    distance, ascending. Scores are ranked after rounding to ``tie_digits``, so that equal vectors tie whatever the order
    of summation; ties go by the table key. A query that is in the table is found too. Null vectors take no part.
    ``counter``: an accumulator of two numbers, to which the tasks add the (query, block or cell) pairs and the skipped ones.
    """
    if method not in METHODS:
        raise ValueError(method)
    q, t = _clean(queries, query_key), _clean(table, table_key)
    kind = {c: x.schema["key"].dataType.simpleString() for c, x in (("q", q), ("t", t))}
    schema = f"qid {kind['q']}, key {kind['t']}, score double, rank double"
    rows = q.limit(QUERIES + 1).collect()
    dim = len(rows[0]["vec"]) if rows else 1
    if len(rows) <= QUERIES:
        found = _few(rows, dim, to_arrow_type(q.schema["key"].dataType), t, k, method, tie_digits, counter, schema)
    else:
        found = _many(q, dim, t, k, method, tie_digits, counter, schema)
    found = found.withColumnRenamed("rank", "__r")
    return top_n_per_group(found, ["qid"], [F.asc("__r"), F.asc("key")], k).drop("__r")

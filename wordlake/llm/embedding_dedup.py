"""Operator 3, embedding near-dedup: vectors sorted by concatenated random hashes, neighbours in the order compared.

A pass gives every vector a key of ``LEVELS + FINE`` bits, each the side of a random projection's cut. The first bits are
cut level by level at quantiles of the rows that the bits before have left together, as deep as a sample reaches, so a
direction that all vectors share moves the cuts with it; the other bits are cut at the mean of the sampled rows of that
place. The rows are sorted by key, each is compared with the ``span`` rows after it by exact cosine, and the pairs at
the limit or above are united over all passes. A run of equal keys longer than the window is compared whole, in blocks.

Window and passes follow from the vectors: neighbours exactly at the limit are made up for sampled rows, some in any
direction and some towards other rows, and passes are added until ``TARGET`` of either kind have shared, in some pass, a
key prefix that no more rows than a window have. Prefixes finer than the sample tells are taken to halve their rows with
each bit. Of several windows the cheapest is taken; comparing all rows with all is among them. For vectors that point
evenly in 64 directions a row meets about six times as many rows in a billion as in a million.

Equal vectors are one row from the start, with their number. In a last step the components' own vectors are compared
in blocks, which counts every link inside a component exactly. Tasks see blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordlake.llm.components import connected_components
from wordlake.session import cut_lineage

TARGET = 0.995
BLOCK = 1024
#: Rows of a block of a run of equal keys; the windows tried, and the bytes of vectors a window may hold.
PART, SPANS, HELD = 2048, (4096, 2048, 1024, 512), 8 << 20
#: Bits of a key: cut at quantiles of the sample, cut at means.
LEVELS, FINE = 14, 38
#: Bytes of the sample on the driver, its rows in a cell at least; made-up neighbours of either kind.
SAMPLE, FEW, PROBES = 16 << 20, 16, 4000
SEED = 20_011


def _unit(vectors, dim: int) -> np.ndarray:
    """Rows of double length 1, from float arrays as bytes, of 4 or 8 a component."""
    m = np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype(float) for v in vectors])
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _planes(dim: int, turn: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, turn]).standard_normal((dim, LEVELS + FINE))


def _cells(projected: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The cell of each row; ``cuts[level]`` has a cut for every cell of the level, nan where it is left whole."""
    cell, open_ = np.ones(len(projected), np.int64), np.ones(len(projected), bool)
    for level, cut in enumerate(cuts):
        at = np.full(len(cell), np.nan)
        at[open_] = cut[cell[open_] - (1 << level)]
        open_ &= ~np.isnan(at)
        cell[open_] = 2 * cell[open_] + (projected[open_, level] > at[open_])
    return cell


def _cuts(projected: np.ndarray, each: float, size: int, rnd) -> list[np.ndarray]:
    """Cuts after which a cell has about ``size`` rows, a sampled row standing for ``each``."""
    cell, open_, cuts = np.ones(len(projected), np.int64), np.ones(len(projected), bool), []
    for level in range(LEVELS):
        count = np.bincount(cell[open_] - (1 << level), minlength=1 << level)
        whole = (count * each <= size) | (count < 2 * FEW)
        open_ &= ~whole[cell * open_ - (1 << level) * open_]
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        at = at[np.lexsort((projected[at, level], cell[at]))]
        count = np.where(whole, 0, count)
        place = np.cumsum(count) - count + (count * rnd.uniform(0.4, 0.6, len(count))).astype(np.int64)
        cut = np.full(1 << level, np.nan)
        cut[~whole] = projected[at[place[~whole]], level]
        cell[open_] = 2 * cell[open_] + (projected[open_, level] > cut[cell[open_] - (1 << level)])
        cuts.append(cut)
    return cuts


def _probes(unit: np.ndarray, least: float, rnd) -> tuple[np.ndarray, np.ndarray]:
    """(row, neighbour at the limit): PROBES in any direction, then as many towards another sampled row."""
    row = rnd.integers(0, len(unit), 2 * PROBES)
    other = unit[rnd.integers(0, len(unit), 2 * PROBES)]
    noise = rnd.standard_normal(other.shape)
    way = np.concatenate((noise[:PROBES], other[PROBES:] + 1e-6 * noise[PROBES:]))
    x = unit[row]
    way -= (way * x).sum(1, keepdims=True) * x
    way /= np.maximum(np.sqrt((way * way).sum(1, keepdims=True)), 1e-300)
    return row, least * x + np.sqrt(max(0.0, 1 - least * least)) * way


def _keys(projected: np.ndarray, turn) -> np.ndarray:
    """The key of each row in a pass ``(cuts, leaves, means)``; rows in a leaf without a sampled row take the last mean."""
    cuts, leaves, means = turn
    cell = _cells(projected, cuts)
    depth = np.frexp(cell.astype(float))[1] - 1
    place = np.searchsorted(leaves, cell)
    place[(place == len(leaves)) | (leaves[np.minimum(place, len(leaves) - 1)] != cell)] = len(leaves)
    key = (cell - (1 << depth)) << (LEVELS - depth)
    for k in range(FINE):
        key = 2 * key + (projected[:, LEVELS + k] > means[place, k])
    return key


def _turn(projected: np.ndarray, each: float, span: int, rnd):
    """A pass: its cuts, its leaves and their means, the mean of all rows last."""
    cuts = _cuts(projected, each, span // 2, rnd)
    leaves, of, count = np.unique(_cells(projected, cuts), return_inverse=True, return_counts=True)
    total = np.zeros((len(leaves), FINE))
    np.add.at(total, of, projected[:, LEVELS:])
    return cuts, leaves, np.concatenate((total / count[:, None], projected[:, LEVELS:].mean(0, keepdims=True)))


def _sharing(keys: np.ndarray, one: np.ndarray, two: np.ndarray, each: float) -> np.ndarray:
    """About how many rows have the prefix that the keys ``one`` and ``two`` share; ``keys`` are a sample, sorted."""
    bits = LEVELS + FINE
    shared = np.where(one == two, bits, bits - np.frexp((one ^ two).astype(float))[1])
    rows, known = np.full(len(one), np.inf), np.zeros(len(one), np.int64)
    for depth in range(bits + 1):
        low = (one >> (bits - depth)) << (bits - depth)
        count = np.searchsorted(keys, low + (1 << (bits - depth))) - np.searchsorted(keys, low)
        told = (depth <= shared) & ((count >= FEW) | (depth <= LEVELS))
        rows[told], known[told] = np.maximum(count[told], 1), depth
    return rows * each * 0.5 ** (shared - known)


def passes_for(unit: np.ndarray, rows: int, least: float) -> tuple[int, list]:
    """The window and the passes for so many ``rows``, of which ``unit`` is a sample; no pass: all rows have one key."""
    dim = unit.shape[1] if len(unit) else 1
    spans = [s for s in SPANS if s * dim * 8 <= HELD] or SPANS[-1:]
    best, chosen = rows + 2048.0 * max(1.0, rows / PART), (spans[0], [])  # compared rows, and moving a row as 2048 of them
    if not len(unit):
        return chosen
    for span in spans:
        if rows <= span + 1:
            continue
        rnd = np.random.default_rng([SEED, dim, span])
        row, near = _probes(unit, least, rnd)
        met, turns, spent = np.zeros(len(row), bool), [], 0.0
        while spent < best and met.reshape(2, -1).mean(1).min() < TARGET:
            planes = _planes(dim, len(turns))
            projected = unit @ planes
            turn = _turn(projected, rows / len(unit), span, rnd)
            keys = _keys(projected, turn)
            met |= _sharing(np.sort(keys), keys[row], _keys(near @ planes, turn), rows / len(unit)) <= span
            spent += span + 2048 * 1.25
            turns.append(turn)
        if spent < best:
            best, chosen = spent, (span, turns)
    return chosen


def embedding_components(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; so do vectors of
    different length. Equal vectors (repeated rows too) link. Rows with a null id take part, a component of such rows
    alone has a null id. Other columns are not read. No rows give no rows.
    """
    x = F.col("embedding")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))
    v = v.withColumn("fine", fine).withColumn("a", F.xxhash64("embedding")).withColumn("b", F.xxhash64(F.lit(7), "embedding"))
    rows = v.where("fine").groupBy("a", "b").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))

    def packed(batches):
        for batch in batches:
            full = [np.array(e, "<f8") for e in batch.column(4).to_pylist()]
            with np.errstate(over="ignore"):
                half = [e.astype("<f4") for e in full]
            raw = [(h if (h == e).all() else e).tobytes() for h, e in zip(half, full)]  # 4 bytes where they say the same
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(e) for e in full], pa.int32()), pa.array(raw, pa.binary())], names=["a", "b", "id", "copies", "dim", "vector"])

    rows = rows.mapInArrow(packed, "a long, b long, id long, copies long, dim int, vector binary")
    rows = cut_lineage(rows.withColumn("sid", F.monotonically_increasing_id()))
    links = cut_lineage(_neighbours(rows, least))
    groups = cut_lineage(connected_components(links, "x", "y"))
    counts = _counted(groups, rows, least)
    named = rows.join(groups, rows["sid"] == groups["node"], "left").select("sid", "a", "b", "id", "copies", F.coalesce("component", "sid").alias("component"))
    first = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(first, "component").join(counts, "sid", "left")
    named = named.select("a", "b", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = v.select("vec_id", "fine", "a", "b").join(named.withColumn("fine", F.lit(True)), ["fine", "a", "b"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _united(top: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``top``, the least member of each row's group, after the rows ``p`` and ``q`` are united."""
    while len(p):
        p, q = top[p], top[q]
        apart = p != q
        p, q = np.maximum(p, q)[apart], np.minimum(p, q)[apart]
        np.minimum.at(top, p, q)
        while (top[top] != top).any():
            top = top[top]
    return top


def _edges(sid: np.ndarray, top: np.ndarray) -> pa.Table:
    at = np.flatnonzero(top != np.arange(len(sid)))
    x, y = sid[at], sid[top[at]]
    return pa.table({"x": np.minimum(x, y)[x != y], "y": np.maximum(x, y)[x != y]})


def _neighbours(rows: DataFrame, least: float) -> DataFrame:
    """Edges (x, y) that unite the rows whose links some window meets; an edge itself need not be a link."""
    many = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > SPANS[-1]).collect()}
    plans = {}
    for dim, n in many.items():
        every = -(-n * dim * 8 // SAMPLE)
        sample = rows.where((F.col("dim") == dim) & (F.pmod("a", F.lit(every)) == 0)).select("a", "b", "vector").toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
        plans[dim] = passes_for(_unit(sample.column("vector").to_pylist(), dim) if sample.num_rows else np.zeros((0, dim)), n, least)
    plans = rows.sparkSession.sparkContext.broadcast(plans)  # 2^LEVELS cuts and as many sampled means a pass at most

    def hashed(batches):
        for batch in batches:
            sid, dims, vectors = batch.columns
            dims = dims.to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                mine = sid.take(pa.array(at))
                span, turns = plans.value.get(dim, (SPANS[-1], []))
                unit = _unit(vectors.take(pa.array(at)).to_pylist(), dim) if turns else None
                for p in range(max(1, len(turns))):
                    key = _keys(unit @ _planes(dim, p), turns[p]) if turns else np.zeros(len(at), np.int64)
                    same = [pa.array(np.full(len(at), x, np.int32)) for x in (dim, p, span)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(key), mine], names=["dim", "turn", "span", "key", "sid"])

    order = ["dim", "turn", "key", "sid"]
    keys = rows.select("sid", "dim", "vector").mapInArrow(hashed, "dim int, turn int, span int, key long, sid long")
    place = F.monotonically_increasing_id()
    keys = cut_lineage(keys.orderBy(*order).withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)))
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = keys.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("start"))  # a row a partition
    keys = keys.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("place"))

    size = 4 * F.col("span")
    block = F.floor(F.col("place") / size)
    near_end = F.pmod("place", size) >= size - F.col("span")  # the next block's first rows look back at these
    blocks = F.explode(F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))).alias("block")
    tasks = keys.select("sid", "dim", "turn", "span", "place", blocks).join(rows.select("sid", "vector"), "sid")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        turn, sid, place = (table.column(c).to_numpy() for c in ("turn", "sid", "place"))
        span, block = table.column("span")[0].as_py(), table.column("block")[0].as_py()
        unit = _unit(table.column("vector").to_pylist(), table.column("dim")[0].as_py())
        top = np.arange(len(sid))
        ends = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
        for s, e in zip(ends, ends[1:]):
            for i in range(s, e, 256):
                p, q = np.nonzero(unit[i : min(e, i + 256)] @ unit[i : min(e, i + 256 + span)].T >= least)
                ok = (q > p) & (q - p <= span) & (place[i + q] >= 4 * span * block)
                top = _united(top, i + p[ok], i + q[ok])
        return _edges(sid, top)

    edges = tasks.groupBy("dim", "block").applyInArrow(compare, "x long, y long")
    runs = cut_lineage(keys.groupBy("dim", "turn", "key").agg(F.count("*").alias("n"), F.first("span").alias("span")).where("n > span + 1").select("dim", "turn", "key", F.ceil(F.col("n") / PART).alias("parts")))
    if runs.isEmpty():
        return edges.distinct()
    tasks = keys.select(*order).join(runs, order[:3]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    tasks = tasks.select(*order, "part", _pairs().alias("t")).select(*order, "part", "t.one", "t.two").join(rows.select("sid", "vector"), "sid")

    def whole(table: pa.Table) -> pa.Table:
        part, sid = table.column("part").to_numpy(), table.column("sid").to_numpy()
        one, two, dim = (table.column(c)[0].as_py() for c in ("one", "two", "dim"))
        unit = _unit(table.column("vector").to_pylist(), dim)
        a, b = np.flatnonzero(part == one), np.flatnonzero(part == two)
        top = np.arange(len(sid))
        for i in range(0, len(a), 256):
            p, q = np.nonzero(unit[a[i : i + 256]] @ unit[b].T >= least)
            top = _united(top, a[i + p], b[q])
        return _edges(sid, top)

    return edges.unionByName(tasks.groupBy(*order[:3], "one", "two").applyInArrow(whole, "x long, y long")).distinct()


def _pairs():
    """The pairs of blocks that a row of ``part`` out of ``parts`` takes part in."""
    return F.expr("explode(transform(sequence(0L, parts - 1), p -> struct(least(part, p) as one, greatest(part, p) as two)))")


def _counted(groups: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(sid, others): how many vectors of its component each row links with, its own copies left out."""
    size = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = groups.join(size, "component").select(F.col("node").alias("sid"), "component", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    tasks = placed.select("sid", "component", "part", _pairs().alias("t")).select("sid", "component", "part", "t.one", "t.two")
    tasks = tasks.join(rows.select("sid", "copies", "dim", "vector"), "sid")

    def count(table: pa.Table) -> pa.Table:
        part, one, two = (table.column(c)[0].as_py() if c != "part" else table.column(c).to_numpy() for c in ("part", "one", "two"))
        sid, copies, unit = table.column("sid").to_numpy(), table.column("copies").to_numpy(), _unit(table.column("vector").to_pylist(), table.column("dim")[0].as_py())
        out = np.zeros(len(sid), np.int64)
        sides = [(np.flatnonzero(part == one), np.flatnonzero(part == two))]
        if one != two:
            sides.append(sides[0][::-1])
        for a, b in sides:
            linked = unit[a] @ unit[b].T >= least
            if one == two:
                np.fill_diagonal(linked, False)
            out[a] += linked @ copies[b]
        return pa.table({"sid": sid, "others": out})

    return tasks.groupBy("component", "one", "two").applyInArrow(count, "sid long, others long").groupBy("sid").agg(F.sum("others").alias("others"))

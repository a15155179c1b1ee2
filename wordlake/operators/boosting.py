"""M4 / M5: boosting by second-order gain, with trees on histograms or a linear model by block coordinate steps.

Every pass is one scan of a written table: a task bins its rows, works out margins, gradients and second derivatives from
the model so far (which travels with the task), and sums them per (node, feature, bin) or per block of coefficients. Spark
adds up the tasks' sums; the driver sees at most nodes x features x bins numbers, chooses splits or solves one block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.session import cut_lineage


def derivatives(objective: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the margin: squared error, or log loss of 0 / 1 labels."""
    if objective == "squared":
        return margin - y, np.ones_like(margin)
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


@dataclass
class Trees:
    """A node is (feature, cut, left, right) or a leaf's value; values at most at the cut go left, missing ones too."""

    objective: str
    base: float
    rate: float
    trees: list[list] = field(default_factory=list)

    @staticmethod
    def reached(tree: list, x: np.ndarray) -> np.ndarray:
        """The node where each row ends."""
        at = np.zeros(len(x), np.int64)
        for n, node in enumerate(tree):  # children come after their parent
            if isinstance(node, tuple):
                here = np.flatnonzero(at == n)
                feature, cut, left, right = node
                at[here] = np.where(x[here, feature] > cut, right, left)
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * np.array([0.0 if isinstance(n, tuple) else n for n in tree])[self.reached(tree, x)]
        return out


@dataclass
class Linear:
    objective: str
    weights: np.ndarray
    intercept: float
    scale: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num(x) / self.scale @ self.weights + self.intercept


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _table(rows: DataFrame, cols: list[str], label: str) -> DataFrame:
    return cut_lineage(rows.where(F.col(label).isNotNull()).select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), F.col(label).cast("double").alias("y")))


def _start(objective: str, mean: float) -> float:
    if objective == "squared":
        return mean
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def best_split(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut after a bin; g and h are sums per (feature, bin). No cut: gain 0."""
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = 0.5 * (left_g ** 2 / (left_h + l2) + right_g ** 2 / (right_h + l2) - all_g ** 2 / (all_h + l2))
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def _histograms(data: DataFrame, model: Trees, tree: list, nodes: list[int], cuts: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of g and h per (feature, bin) of the rows that end in each of ``nodes``."""
    bins = max(len(c) for c in cuts) + 1

    def partial(batches):
        held = {n: np.zeros((2, len(cuts), bins)) for n in nodes}
        for batch in batches:
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
            if not len(y):
                continue
            g, h = derivatives(model.objective, model.margin(x), y)
            at = Trees.reached(tree, x)
            for n in nodes:
                rows = np.flatnonzero(at == n)
                for f, c in enumerate(cuts):
                    v = x[rows, f]
                    place = np.where(np.isnan(v), 0, np.searchsorted(c, v, "left"))
                    held[n][0, f] += np.bincount(place, g[rows], bins)
                    held[n][1, f] += np.bincount(place, h[rows], bins)
        for n, sums in held.items():
            f, b = np.nonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), n, np.int32)), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[0, f, b]), pa.array(sums[1, f, b])],
                                             names=["node", "f", "b", "g", "h"])

    sums = data.mapInArrow(partial, "node int, f int, b int, g double, h double").groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    out = {n: (np.zeros((len(cuts), bins)), np.zeros((len(cuts), bins))) for n in nodes}
    for r in sums.collect():  # at most nodes x features x bins
        out[r["node"]][0][r["f"], r["b"]], out[r["node"]][1][r["f"], r["b"]] = r["g"], r["h"]
    return out


def fit_trees(rows: DataFrame, cols: list[str], label: str, objective: str = "squared", rounds: int = 10, depth: int = 3, rate: float = 0.3,
              l2: float = 1.0, bins: int = 32, least: float = 1.0) -> Trees:
    """Trees grown level by level on ``bins`` quantile bins a feature; ``least`` is the smallest sum of second derivatives
    of a child. Rows without a label take no part; missing values go with the smallest."""
    data = _table(rows, cols, label)
    ways = [float(q) / bins for q in range(1, bins)]
    found = data.agg(F.avg("y").alias("mean"), *(F.percentile_approx(F.col("x")[j], ways, 1000).alias(f"q{j}") for j in range(len(cols)))).first()
    if found["mean"] is None:
        return Trees(objective, 0.0, rate)
    cuts = [np.unique(np.array(found[f"q{j}"] or [0.0])) for j in range(len(cols))]
    model = Trees(objective, _start(objective, found["mean"]), rate)
    for _ in range(rounds):
        tree: list = [0.0]
        open_nodes = [0]
        for level in range(depth):
            sums = _histograms(data, model, tree, open_nodes, cuts)
            following = []
            for n in open_nodes:
                g, h = sums[n]
                gain, f, b = best_split(g, h, l2, least)
                if level == 0:
                    tree[n] = float(-g[0].sum() / (h[0].sum() + l2))
                if gain > 1e-12 and b < len(cuts[f]):
                    left, right = len(tree), len(tree) + 1
                    for lo, hi in ((0, b + 1), (b + 1, g.shape[1])):
                        tree.append(float(-g[f, lo:hi].sum() / (h[f, lo:hi].sum() + l2)))
                    tree[n] = (f, float(cuts[f][b]), left, right)
                    following += [left, right]
            open_nodes = following
            if not open_nodes:
                break
        model.trees.append(tree)
    return model


def fit_linear(rows: DataFrame, cols: list[str], label: str, objective: str = "squared", rounds: int = 10, rate: float = 1.0,
               l2: float = 1e-3, block: int = 4) -> Linear:
    """A linear model by Newton steps on one block of coefficients after another, the intercept in every block. ``l2`` is
    per row of the data. Features are scaled by their root mean square; missing values count as 0."""
    data = _table(rows, cols, label)
    squares = [F.avg(F.when(~F.isnan(F.col("x")[j]), F.col("x")[j] * F.col("x")[j])).alias(f"s{j}") for j in range(len(cols))]
    found = data.agg(F.avg("y").alias("mean"), F.count("*").alias("n"), *squares).first()
    scale = np.array([np.sqrt(found[f"s{j}"] or 0.0) or 1.0 for j in range(len(cols))])
    model = Linear(objective, np.zeros(len(cols)), _start(objective, found["mean"] or 0.0), scale)
    if not found["n"]:
        return model
    penalty = l2 * found["n"]
    for _ in range(rounds):
        for lo in range(0, len(cols), block):
            mine = list(range(lo, min(lo + block, len(cols))))
            k = len(mine) + 1

            def partial(batches, mine=mine, k=k):
                sums = np.zeros((k + 1, k))
                for batch in batches:
                    x, y = _matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
                    if len(y):
                        g, h = derivatives(model.objective, model.margin(x), y)
                        z = np.column_stack([np.nan_to_num(x[:, mine]) / model.scale[mine], np.ones(len(y))])
                        sums[:k] += z.T @ (z * h[:, None])
                        sums[k] += z.T @ g
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], names=["s"])

            # one small matrix a partition
            sums = sum(np.frombuffer(r["s"]).reshape(k + 1, k) for r in data.mapInArrow(partial, "s binary").collect())
            ridge = np.diag([penalty] * (k - 1) + [1e-12])
            step = np.linalg.solve(sums[:k] + ridge, sums[k] + np.append(penalty * model.weights[mine], 0.0))
            model.weights[mine] -= rate * step[:-1]
            model.intercept -= rate * float(step[-1])
    return model


def predict(rows: DataFrame, cols: list[str], model: Trees | Linear, keep: list[str], out: str = "prediction") -> DataFrame:
    """(keep..., prediction): the margin, or the probability of label 1 for the log loss."""
    kept = rows.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("__x"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]] + [f"`{out}` double"])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("__x"))
            margin = model.margin(x) if len(x) else np.zeros(0)
            value = margin if model.objective == "squared" else 1 / (1 + np.exp(-margin))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value)], names=[*batch.schema.names[:-1], out])

    return kept.mapInArrow(run, schema)

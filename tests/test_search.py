"""Nearest search against brute force, both ways, and what the bounds skip."""

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam

from wordlake.operators import search as se
from wordlake.operators import vectors as ve

SCORE = {"cos": lambda a, b: -a @ b, "euclid": lambda a, b: ((a - b) ** 2).sum(), "l1": lambda a, b: abs(a - b).sum()}


class _Two(AccumulatorParam):
    def zero(self, value):
        return np.zeros(2)

    def addInPlace(self, a, b):
        return a + b


@pytest.mark.parametrize("most", [4096, 5])
def test_both_ways_equal_brute_force(spark, monkeypatch, most):
    """More rows than a block and a buffer, more queries than one way takes, ties by key, null vectors left out."""
    monkeypatch.setattr(se, "QUERIES", most)
    monkeypatch.setattr(se, "BUFFER", 40)
    monkeypatch.setattr(se, "PIVOTS", 9)
    rng = np.random.default_rng(3)
    t, q = rng.integers(-3, 4, (160, 3)).astype(float), rng.integers(-3, 4, (20, 3)).astype(float)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(t)] + [(999, None)], "word long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "qid string, vec array<double>")
    for method, score in SCORE.items():
        want = {(f"q{i}", j, k + 1) for i, x in enumerate(q) for k, j in enumerate(sorted(range(len(t)), key=lambda j: (score(x, t[j]), j))[:4])}
        assert {(r.qid, r.key, r["rank"]) for r in ve.nearest(queries, table, 4, method).collect()} == want
    assert ve.nearest(queries, table.limit(2), 4).count() == 40  # fewer rows than k
    assert ve.nearest(queries, table.limit(0), 4).count() == 0 and ve.nearest(queries.limit(0), table, 4).count() == 0


@pytest.mark.parametrize("most", [4096, 5])
def test_bounds_skip_most_of_clustered_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(se, "QUERIES", most)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 16)) * 4
    t = centre[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.3
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(t)], "word long, vec array<double>").repartition(2)
    queries = spark.createDataFrame([(i, (t[i * 50] + 0.01).tolist()) for i in range(30)], "qid long, vec array<double>")
    counter = spark.sparkContext.accumulator(np.zeros(2), _Two())
    got = {(r.qid, r.key) for r in se.nearest(queries, table, 5, "euclid", counter=counter).collect()}
    assert got == {(i, int(j)) for i in range(30) for j in np.argsort(((t - t[i * 50] - 0.01) ** 2).sum(axis=1))[:5]}
    pairs, skipped = counter.value
    assert skipped > 0.8 * pairs > 0

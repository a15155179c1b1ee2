"""Symbols, not tokens, meet the vector table."""

from wordlake.operators import vectors as ve


def test_coverage_and_matrix(spark):
    tokens = spark.createDataFrame([(i, x) for i, x in enumerate(["b", "a", "b", None, "x", "c", "b"])], "pos int, token string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0]), ("q", [4.0])], "word string, vec array<double>")
    mat, cov = ve.compact_embedding(tokens, vectors, ["pos"], 1)
    assert {(r.idx, r.symbol, r.vec[0]) for r in mat.collect()} == {(0, "<UNK>", 0.0), (1, "b", 2.0), (2, "a", 1.0), (3, "c", 3.0)}
    assert [(r.total, r.matched, round(r.coverage, 6)) for r in cov.collect()] == [(7, 5, 0.714286)]
    assert [(r.total, r.matched, r.coverage) for r in ve.compact_embedding(tokens.limit(0), vectors, ["pos"], 1)[1].collect()] == [(0, 0, None)]
    assert "LeftSemi" not in cov._jdf.queryExecution().optimizedPlan().toString()

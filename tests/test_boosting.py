"""Boosting against plain numpy and the constant answer; sketches; common directions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordlake.operators import boosting as bo
from wordlake.operators import sketches as sk
from wordlake.operators import vectors as ve

COLS = ["a", "b", "c"]


def data(n=600, seed=1, binary=False):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] * 0.5 + rng.normal(size=n) * 0.1
    return x, (y > 0.2).astype(float) if binary else y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double").repartition(parts)


def plain_trees(x, y, cuts, objective, base, rounds, depth, rate, l2):
    """The same greedy rule, row by row: every node tries every cut of every feature."""
    margin = np.full(len(y), base)
    for _ in range(rounds):
        g, h = bo.derivatives(objective, margin, y)
        value = np.zeros(len(y))

        def grow(rows, level):
            best = (1e-12, None)
            score = lambda s: g[s].sum() ** 2 / (h[s].sum() + l2)
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left = rows[x[rows, f] <= c]
                    right = rows[x[rows, f] > c]
                    if h[left].sum() >= 1 and h[right].sum() >= 1:
                        gain = 0.5 * (score(left) + score(right) - score(rows))
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
            if level == depth or best[1] is None:
                value[rows] = -g[rows].sum() / (h[rows].sum() + l2)
            else:
                for side in best[1]:
                    grow(side, level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + rate * value
    return margin


@pytest.mark.parametrize("binary", [False, True])
def test_trees_equal_plain_numpy(spark, binary):
    x, y = data(300, binary=binary)
    objective = "logistic" if binary else "squared"
    model = bo.fit_trees(frame(spark, x, y), COLS, "y", objective, rounds=2, depth=2, bins=8)
    rows = frame(spark, x, y)
    ways = [q / 8 for q in range(1, 8)]
    found = rows.agg(*(F.percentile_approx(c, ways, 1000).alias(c) for c in COLS)).first()
    cuts = [np.unique(found[c]) for c in COLS]
    want = plain_trees(x, y, cuts, objective, bo._start(objective, y.mean()), 2, 2, 0.3, 1.0)
    assert np.allclose(model.margin(x), want)


@pytest.mark.parametrize("binary", [False, True])
def test_both_beat_the_constant(spark, binary):
    objective = "logistic" if binary else "squared"
    (x, y), (hx, hy) = data(binary=binary), data(seed=2, binary=binary)
    constant = np.full(len(hy), y.mean())
    for model in (bo.fit_trees(frame(spark, x, y), COLS, "y", objective, rounds=4), bo.fit_linear(frame(spark, x, y), COLS, "y", objective, rounds=4, block=2)):
        got = {r["y"]: r["prediction"] for r in bo.predict(frame(spark, hx, hy), COLS, model, ["y"]).collect()} if not binary else None
        p = np.array([r["prediction"] for r in bo.predict(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(hx)], "k int, a double, b double, c double"), COLS, model, ["k"]).orderBy("k").collect()])
        loss = (lambda q: -(hy * np.log(q) + (1 - hy) * np.log(1 - q)).mean()) if binary else (lambda q: ((q - hy) ** 2).mean())
        assert loss(p) < 0.7 * loss(constant)
        assert binary or len(got) > 1


def test_linear_equals_the_normal_equations(spark):
    x, y = data()
    model = bo.fit_linear(frame(spark, x, y), COLS, "y", "squared", rounds=40, l2=0.0, block=2)
    z = np.column_stack([x, np.ones(len(y))])
    assert np.allclose(model.margin(x), z @ np.linalg.lstsq(z, y, rcond=None)[0], atol=1e-5)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1.0, None, 2.0, 1.0), (None, None, None, None), (3.0, 1.0, None, 0.0)] * 5, "a double, b double, c double, y double")
    for model in (bo.fit_trees(rows, COLS, "y", rounds=2), bo.fit_linear(rows, COLS, "y", rounds=2), bo.fit_trees(rows.limit(0), COLS, "y"), bo.fit_linear(rows.limit(0), COLS, "y")):
        assert all(np.isfinite(r["prediction"]) for r in bo.predict(rows, COLS, model, ["y"]).collect())
        assert bo.predict(rows.limit(0), COLS, model, ["y"]).count() == 0


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("v"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"))
    df = df.unionByName(spark.createDataFrame([(None, "hot")], "v long, k string"))
    by = sk.distinct_sketches(df, "k", "v")
    exact = {r["k"]: r["n"] for r in df.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    for r in sk.estimates(by).collect():
        assert abs(r["n"] - exact[r["k"]]) <= 4 * sk.standard_error() * exact[r["k"]]
    every = sk.estimates(sk.merged(by.withColumn("all", F.lit(1)), "all")).first()["n"]
    assert abs(every - 20_000) <= 4 * sk.standard_error() * 20_000


def test_common_direction_is_taken_out(spark):
    rng = np.random.default_rng(4)
    words = {f"w{i}": rng.normal(size=6) * 0.2 + np.array([3, 0, 0, 1, 0, 0]) for i in range(30)}
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in words.items()], "word string, vec array<double>")
    texts = [(k, [f"w{rng.integers(0, 30)}" for _ in range(8)] + ["absent"]) for k in range(40)]
    tokens = spark.createDataFrame([(k, t) for k, ts in texts for t in ts], "k int, token string")
    count = {}
    for _, ts in texts:
        for t in ts:
            count[t] = count.get(t, 0) + 1
    total = sum(count.values())
    weight = {t: 1e-3 / (1e-3 + c / total) for t, c in count.items()}
    x = np.array([sum(weight[t] * words.get(t, np.zeros(6)) for t in ts) / sum(weight[t] for t in ts) for _, ts in texts])
    first = np.linalg.svd(x)[2][0]
    x = x - np.outer(x @ first, first)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {r["k"]: r["vec"] for r in ve.weighted_text_vectors(tokens, vectors, "k", 6).collect()}
    assert np.allclose([got[k] for k, _ in texts], x, atol=1e-6)


def test_text_vectors_in_blocks_and_slices(spark, monkeypatch):
    """Blocks and slices of few cells, words with two vectors, none, a null key, two key columns: as a plain mean."""
    monkeypatch.setattr(ve, "BLOCK_CELLS", 7)
    rng = np.random.default_rng(5)
    words = [(f"w{i % 25}", (rng.normal(size=4) if i % 2 else rng.integers(0, 9, 4) / 8).tolist()) for i in range(30)]  # w0 to w4 twice
    texts = {(None if k == 3 else k % 4, "ab"[k % 2]): [f"w{rng.integers(0, 40)}" for _ in range(60 if k == 0 else 6)] for k in range(8)}
    tokens = spark.createDataFrame([(*k, w) for k, ws in texts.items() for w in ws], "k int, s string, token string")
    made = ve.text_vectors(tokens, spark.createDataFrame(words, "word string, vec array<double>"), ["k", "s"], 4, normalize_out=False)
    got = {(r.k, r.s): r.vec for r in made.collect()}
    assert set(got) == set(texts)
    for k, ws in texts.items():
        rows = [v for w in ws for v in ([v for x, v in words if x == w] or [[0.0] * 4])]
        assert np.allclose(got[k], np.mean(rows, axis=0))


def test_no_vector_travels_for_every_word_of_a_text(spark, tmp_path):
    """200 texts of the same 50 words: a vector comes once to the block of texts, so 50 rows with vectors are exchanged, not 10,000."""
    tokens = spark.range(10_000).select((F.col("id") % 200).alias("k"), F.concat(F.lit("w"), (F.col("id") / 200).cast("int")).alias("token"))
    vectors = spark.range(50).select(F.concat(F.lit("w"), "id").alias("word"), F.array_repeat(F.rand(1), 16).alias("vec"))
    made = ve.text_vectors(tokens, vectors, "k", 16)
    assert made.count() == 200
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [block" in plan, plan


def test_words_of_a_text_are_counted_where_they_are(spark, monkeypatch):
    """A row for a text with numbers for its words, null ones too, and each word once a block; nothing is exchanged before."""
    rows = [(1, "a"), (1, "b"), (1, "a"), (None, "a"), (None, None), (2, None), (1, "c"), (None, None)]
    df = spark.createDataFrame(rows, "k0 int, word string").coalesce(1)
    found = ve._word_blocks(df, ["k0"]).collect()
    words = next(r.words for r in found if r.words)
    assert len(words) == 4 and sum(len(r.words) for r in found) == 4
    assert {r.k0: {words[i]: n for i, n in zip(r["at"], r["n"])} for r in found} == {1: {"a": 2, "b": 1, "c": 1}, None: {"a": 1, None: 2}, 2: {None: 1}}
    assert len(found) == 3 and ve._word_blocks(df.limit(0), ["k0"]).count() == 0
    monkeypatch.setattr(ve, "BLOCK_CELLS", 1)
    many = spark.range(50_000).select((F.col("id") % 3).cast("int").alias("k0"), F.concat(F.lit("w"), F.col("id") % 7).alias("word")).coalesce(1)
    assert ve._word_blocks(many, ["k0"]).selectExpr("count(distinct block) > 1 AND sum(aggregate(n, 0, (a, x) -> a + x)) = 50000").first()[0]

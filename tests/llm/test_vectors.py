"""Operator 3 against all pairs."""

import math

import numpy as np
import pyarrow as pa
from tests.conftest import SF01
from tests.llm.test_jaccard import union_find
from wordlake.llm import embedding_dedup
from wordlake.llm.embedding_dedup import embedding_components
from wordlake.llm.queries import LLM_QUERIES


def brute(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = []
    for d in {len(v) for (_, v), k in zip(rows, ok) if k}:
        at = [i for i, (_, v) in enumerate(rows) if ok[i] and len(v) == d]
        m = np.array([rows[i][1] for i in at], float)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        links += [(at[i], at[j]) for i, j in zip(*np.nonzero(np.triu(m @ m.T >= least, 1)))]
    top, n = union_find(len(rows), links), np.zeros(len(rows), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    least_id = {}
    for (vid, _), t in zip(rows, top):
        if vid is not None:
            least_id[t] = min(vid, least_id.get(t, vid))
    return [(vid, int(k), least_id.get(t), vid == least_id.get(t)) for (vid, _), k, t in zip(rows, n, top)], len(links)


def check(df, rows, recall=1.0):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want, links = brute(rows)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want)
    if recall == 1:
        assert sorted(got, key=key) == sorted(want, key=key)
    by = {r[0]: r for r in want}
    assert all(r[1] <= by[r[0]][1] for r in got if r[0] is not None) or recall == 1
    assert sum(r[1] for r in got) >= recall * 2 * links


SCHEMA = "vec_id long, embedding array<float>, label int, fine string, a string"


def test_odd_rows_and_groups(spark):
    rnd = np.random.default_rng(4)
    rows = [(None, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]),
            (8, [2.0, 4.0]), (9, [-1.0, -2.0]), (10, [1.0, 2.0, 0.0]), (11, [1e-30, 2e-30]), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    base = rnd.standard_normal((6, 12))
    for g in range(6):  # a group of 300 is longer than a window
        rows += [(100 + g * 1000 + i, (base[g] + rnd.standard_normal(12) * 0.1).astype(np.float32).tolist()) for i in range(300 if g == 0 else 15)]
    rows += [(9000 + i, rows[20][1]) for i in range(200)]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(4)
    check(embedding_components(df), rows)
    assert embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    check(LLM_QUERIES["op3_projection_passes"](spark, SF01), rows, 0.98)


def planted(rnd, n, pairs, groups, shared, dim=64, cosine=0.955):
    """n unlinked rows in dense groups that all share a direction, and a neighbour at ``cosine`` for the first ``pairs``."""
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    centre = unit(rnd.standard_normal((groups, dim)))
    m = math.sqrt(1 - shared**2) * unit(centre[rnd.integers(0, groups, n)] + 0.7 * unit(rnd.standard_normal((n, dim))))
    m = unit(m + shared * unit(rnd.standard_normal((1, dim))))
    way = rnd.standard_normal((pairs, dim))
    way = unit(way - (way * m[:pairs]).sum(1, keepdims=True) * m[:pairs])
    return np.concatenate((m, cosine * m[:pairs] + math.sqrt(1 - cosine**2) * way))


def test_recall_on_clustered_vectors(spark):
    for n, groups, shared in ((3000, 1, 0.5), (12000, 3, 0.6), (24000, 40, 0.5)):
        m = planted(np.random.default_rng(n), n, 600, groups, shared)
        df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(m)), "embedding": pa.FixedSizeListArray.from_arrays(m.ravel(), 64).cast(pa.list_(pa.float64()))}))
        got = {r.vec_id: r.component_id for r in embedding_components(df.repartition(4)).collect()}
        found = sum(got[i] == got[n + i] for i in range(600)) / 600
        assert found >= 0.985, (n, groups, shared, found)


def test_run_of_equal_keys(spark, monkeypatch):
    """Keys that tell nothing apart: the run is longer than the window and compared whole."""
    monkeypatch.setattr(embedding_dedup, "PART", 100)
    monkeypatch.setattr(embedding_dedup, "SPANS", (64,))
    monkeypatch.setattr(embedding_dedup, "passes_for", lambda unit, rows, least: (64, []))
    rnd = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(np.repeat(rnd.standard_normal((300, 12)), 2, 0) + 0.05 * rnd.standard_normal((600, 12)))]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    check(embedding_components(df), rows)


def test_windows_reach_over_blocks():
    """Every pair at most a window apart in the order is held by some key prefix or window; far pairs are not counted as met."""
    rnd = np.random.default_rng(9)
    unit = rnd.standard_normal((4000, 16))
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    turn = embedding_dedup._turn(unit @ embedding_dedup._planes(16, 0), 1.0, 512, rnd)
    keys = embedding_dedup._keys(unit @ embedding_dedup._planes(16, 0), turn)
    one, two = rnd.integers(0, 4000, 3000), rnd.integers(0, 4000, 3000)
    told = embedding_dedup._sharing(np.sort(keys), keys[one], keys[two], 1.0)
    place = np.empty(4000, int)
    place[np.argsort(keys, kind="stable")] = np.arange(4000)
    near = (told <= 512) & (told >= embedding_dedup.FEW)
    assert near.any() and (abs(place[one] - place[two])[near] <= 512).all()

"""Look-ups by blocks of rows against plain loops: encoding and term counts."""

import random
from collections import Counter

import pytest

from wordlake.operators import blocks as bl
from wordlake.operators import vocab as vb


def rows(seed, letters="abcdef"):
    rnd = random.Random(seed)
    made = [(i, [rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 40]))]) for i in range(30)]
    return [*made, (30, None), (3, ["a", "f"]), (3, ["b"]), (None, ["a"])]


@pytest.mark.parametrize("unk,block", [(0, 7), (None, 7), (0, 1 << 20)])
def test_encoding(spark, monkeypatch, unk, block):
    """Blocks of few rows; a key of several rows has one sequence, as before, a row without a key an empty one."""
    monkeypatch.setattr(bl, "BLOCK", block)
    df = spark.createDataFrame(rows(1), "k long, w array<string>")
    ids = {"a": 5, "b": 6, "c": 7}
    vocab = spark.createDataFrame([*ids.items()], "symbol string, idx long")
    want = Counter()
    for k, w in rows(1):
        if k == 3:
            together = sorted((p, ids.get(x, unk)) for key, v in rows(1) if key == 3 for p, x in enumerate(v or []) if unk is not None or x in ids)
            seq = [x for _, x in together]
        else:
            seq = [] if k is None else [ids.get(x, unk) for x in w or [] if unk is not None or x in ids]
        want[k, tuple(seq)] += 1
    made = vb.encode_rows(df, "w", vocab, "ids", unk, "k")
    assert Counter((r.k, tuple(r.ids)) for r in made.collect()) == want
    assert Counter((r.k, tuple(r.ids)) for r in vb.encode_arrays(df, "w", vocab, "ids", unk, "k").collect()) == want


def test_encoding_exchanges_no_row_for_each_token(spark):
    df = spark.createDataFrame([(i, ["a", "b"] * 50) for i in range(20)], "k long, w array<string>").coalesce(1)
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, idx long")
    assert bl.found(bl.coded(df, ["k"], "w"), vocab, "symbol").count() == 2


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 9)
    df = spark.createDataFrame([*rows(2), (None, ["a", "z"])], "k long, w array<string>")
    want = Counter((k, x) for k, w in [*rows(2), (None, ["a", "z"])] for x in w or [])
    got = vb.term_counts(df, "w", "k").collect()
    assert {(r.k, r.term): r.tf for r in got} == want and len(got) == len(want)

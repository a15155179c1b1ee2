"""Co-occurrence in blocks of packed cells against plain loops."""

import random
from collections import Counter

from wordlake.operators import blocked_pairs as bp
from wordlake.operators import cooccur as co
from wordlake.operators import sparse as sp


def loop(streams, window, skip_equal):
    out = Counter()
    for s in streams:
        for q in range(len(s)):
            for p in range(max(0, q - window), q):
                if not (skip_equal and s[p] == s[q]):
                    out[s[q], s[p]] += 1
                    out[s[p], s[q]] += 1
    return out


def cells(df):
    rows = [((r.row_word, r.col_word), r.weight) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_matrix_in_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    streams = [[rnd.choice("abcdefgé") * rnd.choice([1, 2]) for _ in range(rnd.choice([0, 1, 2, 30]))] for _ in range(40)]
    df = spark.createDataFrame([*enumerate(streams), (None, None), (3, None)], "id long, w array<string>").repartition(3)
    for pairs in (1 << 21, 100):  # one block, many
        monkeypatch.setattr(bp, "BLOCK_PAIRS", pairs)
        for skip in (True, False):
            assert cells(bp.two_sided(df, "w", 3, skip)) == loop(streams, 3, skip)
            assert cells(bp.stream_two_sided(df.where("id is not null and w is not null"), "w", ["id"], 3, skip)) == loop([sum(streams, [])], 3, skip)
    assert not cells(bp.two_sided(df.limit(0), "w", 3))


def test_partial_sums_are_small(spark):
    """What is exchanged for a cell is two places and a count, not two words."""
    rnd = random.Random(5)
    streams = [([f"{rnd.randrange(400):020d}" for _ in range(500)],) for _ in range(20)]
    df = spark.createDataFrame(streams, "w array<string>").coalesce(1)
    ids, words, size, tokens = bp.numbered(df.selectExpr("monotonically_increasing_id() AS row", "w"), "w", ["row"])
    parts = bp.pieces(ids, "ids", 5, bp.block_count(size, tokens * 5), skip_equal=True)
    held = parts.selectExpr("sum(length(at) + length(col) + length(w)) AS bytes", "sum(length(at) / 2) AS n").first()
    assert held.n >= size * 10 and held.bytes <= 6 * held.n
    assert cells(bp.two_sided(df, "w", 5)) == cells(co.two_sided(df, "w", 5))


def test_gathered_pieces_are_summed(spark):
    cells = [(i % 7, i % 3, 1.0) for i in range(400)]
    df = spark.createDataFrame(cells, "r long, c long, w double").repartition(5)
    packed = sp.packed(df, 2, 2)
    got = Counter()
    for p in packed.collect():
        for at, col, w in zip(*sp.arrays(p["at"], p["col"], p["w"])):
            assert (at * 2 + p["i"], col * 2 + p["j"]) not in got
            got[int(at) * 2 + p["i"], int(col) * 2 + p["j"]] = float(w)
    assert got == Counter((r, c) for r, c, _ in cells)
    packed.unpersist()

"""Windows over packed token rows that carry their keys."""

from collections import Counter

from wordlake.operators import corpus_windows as cw


def test_keyed_windows_join_borders_only(spark):
    data = {"x": "abcdefgh", "y": "q", "z": "stu"}
    tokens = spark.createDataFrame([(s, i, c) for s, t in data.items() for i, c in enumerate(t)], "s string, pos int, token string")
    segments = cw.pack(tokens, ["s", "pos"], stream_col="s", size=4)
    made = cw.skipgram_rows(segments, 2, keyed=True)
    got = Counter((r.key.s, r.key.pos, r.offset, r.word, r.context) for r in made.collect())
    assert got == Counter((s, i, o, c, t[i + o] if 0 <= i + o < len(t) else "--") for s, t in data.items() for i, c in enumerate(t) for o in (-2, -1, 1, 2))

"""Windows over streams of many rows against a plain loop."""

import random
from collections import Counter

import pytest

from wordlake.operators import corpus_windows as cw

PAD = "--"


def loop_pairs(stream, w):
    return Counter((stream[q], stream[p]) for q in range(len(stream)) for p in range(max(0, q - w), q))


def loop_sliding(stream, w):
    out = Counter()
    for t in range(len(stream)):
        for q in range(max(0, t - w), t):
            for p in range(max(0, t - w), q):
                out[stream[q], stream[p]] += 1
    return out


def loop_skipgrams(stream, w):
    return sorted((i, o, x, stream[i + o] if 0 <= i + o < len(stream) else PAD) for i, x in enumerate(stream) for o in range(-w, w + 1) if o)


def streams(seed):
    rng = random.Random(seed)
    return {s: [rng.choice("abcde") for _ in range(n)] for s, n in {"x": 300, "y": 3, "z": 1, "w": 40}.items()}


def summed(rows):
    out = Counter()
    for r in rows.collect():
        out[r["row"], r["col"]] += r["w"]
    return out


@pytest.mark.parametrize("window,size,bucket", [(1, 1, 3), (3, 2, 4), (5, 7, 6), (4, 4096, 1024)])
def test_token_rows(spark, monkeypatch, window, size, bucket):
    """Segments shorter and longer than the window, buckets of few segments, several streams, shuffled rows."""
    monkeypatch.setattr(cw, "BUCKET", bucket)
    data = streams(window)
    rows = [(s, i, x) for s, tokens in data.items() for i, x in enumerate(tokens)] + [("x", 10_000, None)]
    random.Random(1).shuffle(rows)
    segments = cw.pack(spark.createDataFrame(rows, "s string, pos int, token string"), ["pos"], stream_col="s", size=size)
    want, sliding = Counter(), Counter()
    for tokens in data.values():
        want += loop_pairs(tokens, window)
        sliding += loop_sliding(tokens, window)
    assert summed(cw.context_pairs(segments, window)) == want
    if window > 1:
        assert summed(cw.sliding_pairs(segments, window)) == sliding
    keys = {(r["stream"], r["at"]): [k["pos"] for k in r["keys"]] for r in segments.collect()}
    got = {}
    for r in cw.skipgram_rows(segments, window).collect():
        got.setdefault(r["stream"], []).append((keys[r["stream"], r["at"]][r["i"]], r["offset"], r["word"], r["context"]))
    assert {s: sorted(v) for s, v in got.items()} == {s: loop_skipgrams(v, window) for s, v in data.items()}


def test_rows_of_arrays(spark):
    """Arrays of any length, empty and null ones between them, as one stream."""
    rng = random.Random(4)
    arrays = [[rng.choice("abc") for _ in range(rng.choice([0, 0, 1, 1, 2, 9]))] for _ in range(80)] + [None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "k int, a array<string>").repartition(4)
    stream = [x for a in arrays for x in a or []]
    segments = cw.segments_of(df, "a", ["k"])
    assert summed(cw.context_pairs(segments, 4)) == loop_pairs(stream, 4)
    assert summed(cw.sliding_pairs(segments, 4)) == loop_sliding(stream, 4)
    plan = cw.context_pairs(segments, 4)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan
    assert cw.context_pairs(segments.limit(0), 4).count() == 0

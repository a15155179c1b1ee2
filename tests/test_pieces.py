"""Word pieces and their labels against a plain loop over characters."""

import random

import pytest

from wordlake.operators import wordpieces as wp


def loop_cut(word, pieces):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if ("##" if at else "") + word[at:end] in pieces:
                out.append(("##" if at else "") + word[at:end])
                at = end
                break
        else:
            return None
    return out


def made(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4))) for _ in range(12)} | {"##" + "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 3))) for _ in range(8)}
    docs = [(i, ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 9))]) for i in range(80)]
    return pieces | {"##", ""}, docs


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_equal_a_loop_over_characters(spark, seed):
    pieces, docs = made(seed)
    rows = spark.createDataFrame([*docs, (900, None)], "k int, w array<string>")
    got = {r["k"]: (r["tokens"], r["labels"]) for r in wp.piece_labels(rows, "w", "k", spark.createDataFrame([(p,) for p in pieces], "piece string")).collect()}
    unknown = 0
    for k, words in [*docs, (900, [])]:
        marks = [int(i == len(w) - 1) for w in words for i in range(len(w))]
        tokens, labels, at = [], [], 0
        for w in words:
            for t in loop_cut(w, pieces) or [None]:
                at += len(w) if t is None else len(t.removeprefix("##"))
                tokens.append(t or wp.UNKNOWN)
                labels.append(marks[at - 1])
        unknown += tokens.count(wp.UNKNOWN)
        assert got[k] == (tokens, labels)
    assert unknown > 10


def test_realignment_looks_past_unknown_pieces(spark):
    raw = "thecatsatxyzonzzzmat"
    tokens = ["the", "cat", "sat", "[UNK]", "on", "[UNK]", "mat"]
    assert wp.align(tokens, raw) == [3, 6, 9, 12, 14, 17, 20]
    assert wp.align(["[UNK]"], "abc") == [3] and wp.align([], "abc") == [] and wp.align(["a", "[UNK]", "[UNK]"], "abcd") == [1, 2, 4]
    assert wp.align(["[UNK]", "ab", "##c"], "ababc") == [2, 4, 5]  # the last known pieces end the text
    marks = [int(i in (2, 5, 8, 11, 13, 16, 19)) for i in range(len(raw))]
    df = spark.createDataFrame([(1, tokens, raw, marks), (2, [], "", []), (3, None, None, None)], "k int, t array<string>, raw string, m array<int>")
    assert [r["labels"] for r in wp.realigned_labels(df, "t", "raw", "m").orderBy("k").collect()] == [[1] * 7, [], []]


def test_too_many_pieces_are_refused(spark, monkeypatch):
    monkeypatch.setattr(wp, "MOST_PIECES", 2)
    with pytest.raises(ValueError):
        wp.cut_words(spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("a",), ("b",), ("c",)], "piece string"))

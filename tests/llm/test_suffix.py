"""Operator 8 against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark import cloudpickle

from tests.conftest import SF001
from wordlake.llm import anchors as an
from wordlake.llm import suffix_dedup as sd
from wordlake.llm.queries import LLM_QUERIES
from wordlake.llm.suffix_dedup import merge_runs, suffix_dedup


def brute(rows):
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, sha256) of each row."""
    raws = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, raw in raws:
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for (d, raw), (doc, _) in zip(raws, rows):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if first[raw[i : i + 100]] < (d, i):
                gone[i : i + 100] = b"\1" * 100
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_odd_rows(spark, odd_docs, no_docs):
    assert suffix_dedup(no_docs).count() == 0
    check(suffix_dedup(odd_docs), [(r.doc_id, r.text) for r in odd_docs.collect()])


@pytest.mark.parametrize("run", [200_000, 300])
def test_planted_repeats(spark, monkeypatch, run):
    """Passages around the window's length, repeats within a text, periodic texts, copies, bytes of all kinds, null ids."""
    monkeypatch.setattr(sd, "RUN", run)
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnopé漢 \n") for _ in range(n))
    passages = [noise(n) for n in (60, 90, 99, 100, 101, 102, 150, 400)]
    rows = []
    for i in range(120):
        parts = [noise(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 4)):
            parts += [rnd.choice(passages), noise(rnd.choice([0, 1, 3, 80]))]
        rows.append((rnd.randint(0, 10**6), "".join(parts)))
    rows += [(7, "ab" * 400), (9, "x" * 350), (8, "x" * 180 + "\0" * 150 + "y" * 120), (10, "\0" * 130), (5, rows[0][1]), (5, rows[0][1]), (6, rows[1][1]), (6, noise(20) + rows[1][1]),
             (None, rows[2][1]), (None, noise(10) + rows[2][1]), (11, None), (12, ""), (13, noise(99)), (14, noise(30) + rows[3][1][50:] + rows[3][1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(suffix_dedup(df), rows)


def test_merge_is_the_sorted_order():
    rnd = random.Random(3)
    for k in (1, 2, 3, 7, 9):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.choice([3, 50]))).ljust(100, b"\0") for _ in range(rnd.randint(0, 60))) for _ in range(k)]
        share = lambda a, b: next((i for i in range(100) if a[i] != b[i]), 100)
        coded = []
        for r in runs:
            lcp = [0, *(share(a, b) for a, b in zip(r, r[1:]))][: len(r)]
            coded.append((lcp, [x[n:] for x, n in zip(r, lcp)]))
        run, at, lcp = merge_runs(coded)
        got = [runs[r][i] for r, i in zip(run, at)]
        assert got == sorted(x for r in runs for x in r)
        assert lcp == [0, *(share(a, b) for a, b in zip(got, got[1:]))][: len(got)]


def test_the_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    check(LLM_QUERIES["op8_suffix_dedup"](spark, SF001), rows)


def test_kept_text_and_columns(spark, odd_docs):
    got = suffix_dedup(odd_docs, keep=odd_docs.columns, with_text=True).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.in_doc_id == r.doc_id and (r.n_removed or r.kept_text == (r.in_text or ""))
    assert np.sum([r.n_removed for r in got]) > 0


def test_texts_longer_than_a_place(spark, monkeypatch):
    """Positions of 9 bits: texts are worked through in pieces, with the same anchors and the same result."""
    rnd = random.Random(7)
    noise = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    passages = [noise(n) for n in (100, 180, 700)]
    texts = ["".join(rnd.choice([noise(90), "xy" * 130, "z" * 500, *passages]) for _ in range(n)) for n in (0, 1, 2, 30, 5, 12)]
    raws = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    whole = an.anchors(data, offsets, 1 << 26)
    for part in (1 << 18, 300, 511, 100):
        assert all((a == b).all() for a, b in zip(an.anchors(data, offsets, part), whole, strict=True)), part
    monkeypatch.setattr(an, "_PLACE", 9)
    assert all((a == b).all() for a, b in zip(an.anchors(data, offsets), whole, strict=True))
    rows = list(enumerate(texts)) + [(3, texts[4]), (3, texts[3])]
    cloudpickle.register_pickle_by_value(an)  # so that workers see 9 bits too
    try:
        check(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    finally:
        cloudpickle.unregister_pickle_by_value(an)
    monkeypatch.setattr(sd.tb, "BLOCK_BYTES", 1000)
    hashes = sd._text_hashes(data, offsets)
    for i, r in enumerate(raws):  # of the text alone, however it is placed
        one = np.frombuffer(r, np.uint8)
        assert sd._text_hashes(one, np.array([0, len(r)]))[0] == hashes[i]
    assert len(np.unique(hashes)) == len(texts)

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from wordlake.llm import queries
from wordlake.llm.period_runs import PRIME, _backward, _forward, find_runs, occurrences, period_runs
from wordlake.llm.textblocks import U64, mix
from wordlake.sources.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """(start, length, period) from the definition: maximal stretches per period, those of a smaller one left out."""
    first = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                first.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in first.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rng, n, letters):
    w = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n:
            s = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - s) // 3 + 2))
            for i in range(s, rng.randrange(s, n + 1)):
                w[i] = w[s + (i - s) % p]
    return w


def test_transform_and_occurrences():
    rng = np.random.default_rng(3)
    x = rng.integers(0, PRIME, (3, 64)).astype(U64)
    assert (_backward(_forward(x)) == x).all()
    letters = rng.integers(0, 3, 400)
    value = mix(letters.astype(U64)) % U64(PRIME)
    for size, least in ((8, 1), (8, 8), (16, 16)):
        at = np.arange(400 // size) * size
        start, distance = occurrences(value, at, size, least)
        want = {(i, d) for i in at.tolist() for d in range(least, 2 * size) if i + d + size <= 400 and (letters[i : i + size] == letters[i + d : i + d + size]).all()}
        assert set(zip(start.tolist(), distance.tolist())) == want


@pytest.mark.parametrize("letters", [1, 2, 3, 7, 1000])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(80):
        w = made(rng, rng.choice([0, 7, 23, 24, 25, 60, 130, 400]), range(letters))
        start, end, period = find_runs(mix(np.array(w, np.uint64)), len(w))
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())) == brute(w)


def test_operator_on_many_rows(spark, odd_docs, no_docs):
    rng = random.Random(2)
    texts = [" \n".join(made(rng, rng.randrange(0, 300), ["a", "bé", "c" * 30, "漢", "d."])) for _ in range(150)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(1, texts[1], None, None), (None, texts[2], None, None)]
    many = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words string").repartition(3)
    odd = period_runs(odd_docs)
    assert odd.count() == odd_docs.count() and period_runs(no_docs).count() == 0
    for out, given in ((period_runs(many), rows), (odd, [tuple(r) for r in odd_docs.collect()])):
        assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
        want = []
        for doc_id, text, *_ in given:
            w = WORD.findall(text or "")
            runs = brute(w)
            want.append((doc_id, len(w), runs, collapsed(w, runs).encode()))
        assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], bytes(r[3])) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_long_text(spark):
    """A text of megabytes, periodic over all scales, and one of a single word."""
    w = [f"w{i % 70_001}" for i in range(300_000)]
    rows = spark.createDataFrame([(1, " ".join(w)), (2, "a " * 500_000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in period_runs(rows).collect()}
    assert [tuple(x) for x in out[1]["runs"]] == [(0, 300_000, 70_001)] and [tuple(x) for x in out[2]["runs"]] == [(0, 500_000, 1)]
    assert bytes(out[1]["collapsed"]).decode() == " ".join(w[:70_001]) and bytes(out[2]["collapsed"]) == b"a"


def test_smaller_limits_are_refused(spark, no_docs):
    with pytest.raises(ValueError):
        period_runs(no_docs, min_exponent=2)


def test_query_equals_brute_force(spark):
    want = []
    for doc_id, text in table(spark, SF001, "documents").select("doc_id", "text").toLocalIterator():
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        want.append((doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
                     hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
                     hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    rows = queries.op13_period_runs(spark, SF001)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == sorted(want, key=repr)
    assert rows.agg(F.sum("n_runs")).first()[0] > 10
    odd = queries.with_periods(spark.createDataFrame([(None, "a b c"), (33, ""), (33, None)], "doc_id long, text string")).collect()
    assert [r["text"] for r in odd] == ["a b c", "", None]

"""Operator 6: gradients, window cover, and accuracy on held-out rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordlake.llm import textblocks as tb
from wordlake.llm import toxicity as tx
from wordlake.llm.queries import LLM_QUERIES


def test_windows_cover_all_words_twice_over():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        row, first = tx.windows(np.array([n, 5]))
        own = first[row == 0]
        assert {i for f in own for i in range(f, min(n, f + tx.LENGTH))} == set(range(n)) and (np.diff(own) == tx.STEP).all()


def test_gradient_is_the_slope():
    rnd = np.random.default_rng(1)
    net = tx.Network.new(np.arange(6, dtype=tb.U64), rnd.standard_normal(7))
    net.p = {k: (v.astype(np.float64) + 0.1 * rnd.standard_normal(v.shape)) for k, v in net.p.items()}
    _, _, data, offsets = next(tb.blocks(pa.array(["ab abc x", "hello"])))
    w = tb.words(data, offsets)
    grams, size = tx.trigrams(w, np.arange(4))
    index, ids = np.array([0, 3, 6, 2]), np.array([[0, 1, 2, 4], [3, 4, 4, 4], [1, 1, 0, 3]])
    c = np.array([0.3, -1.0, 0.7])
    loss = lambda: float(c @ net.forward(net.inputs(index, grams, size), ids))
    g = net.gradient(net.inputs(index, grams, size), ids, index, grams, size, c)
    for k, v in net.p.items():
        flat = np.flatnonzero(np.abs(g[k].ravel()) > 1e-4)[:5].tolist()
        for i in flat:
            old, out = v.ravel()[i], []
            for e in (1e-2, -1e-2):
                v.ravel()[i] = old + e
                out.append(loss())
            v.ravel()[i] = old
            assert g[k].ravel()[i] == pytest.approx((out[0] - out[1]) / 2e-2, rel=0.03, abs=2e-3), k


def plain_logit(net, words, window):
    """Logit of one window of words, gate by gate; ``words`` maps a word to its input."""
    p, hid = net.p, tx.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
        h = np.zeros(hid)
        for t in order:
            a = words[window[t]] @ p[f"in_{d}"] + p[f"b_{d}"]
            z = sig(a[:hid] + h @ p[f"rec_{d}"][:, :hid])
            r = sig(a[hid : 2 * hid] + h @ p[f"rec_{d}"][:, hid : 2 * hid])
            n = np.tanh(a[2 * hid :] + r * (h @ p[f"rec_{d}"][:, 2 * hid :]))
            h = (1 - z) * n + z * h
            states[d, t] = h
    both = [np.concatenate((states["f", t], states["b", t])) for t in range(len(window))]
    weight = np.exp([np.tanh(b @ p["att"]) @ p["query"] for b in both])
    pool = sum((w / weight.sum() * b for w, b in zip(weight, both)), np.zeros(2 * hid))
    return float(pool @ p["out"] + p["bias"][0])


def test_a_text_scores_as_its_windows_by_a_plain_recursion():
    """Every overlapping window of whole texts, long, empty and of unknown words, in one block or in several."""
    rnd = np.random.default_rng(3)
    texts = ["ab abc x", "", None, " ".join(f"w{i % 37}" for i in range(150)), "Ab   AB\nab", " ".join(["same"] * 33)]
    _, _, data, offsets = next(tb.blocks(pa.array(texts)))
    w = tb.words(data, offsets, lower=True)
    value, first = np.unique(w.hash, return_index=True)
    net = tx.Network.new(value[::2], rnd.standard_normal(len(value[::2]) + 1))
    net.p = {k: (v.astype(np.float64) + 0.1 * rnd.standard_normal(v.shape)) for k, v in net.p.items()}
    inputs = net.inputs(net.index(w.hash[first]), *tx.trigrams(w, first))
    words = {w.text(i): x for i, x in zip(first.tolist(), inputs)}
    want = []
    for text in texts:
        own = [x.encode() for x in (text or "").lower().split()]
        starts = range(0, max(1, len(own) - tx.LENGTH + tx.STEP), tx.STEP)
        want.append(max(plain_logit(net, words, own[i : i + tx.LENGTH]) for i in starts))
    assert net.logits(data, offsets) == pytest.approx(want, rel=1e-4, abs=1e-5)
    alone = [net.logits(d, o)[0] for t in texts for _, _, d, o in tb.blocks(pa.array([t], pa.string()))]
    assert alone == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_held_out_accuracy(spark):
    got = LLM_QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    recall = sum(r.predicted for r in rows if r.toxic) / max(1, sum(r.toxic for r in rows))
    assert right > 0.95 and recall > 0.8, (right, recall)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (12, 1), (12, 0), (10, 0), (99, 1), (None, 1), (5, None), (6, 7), (14, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0), labels.where("toxic = 0")):
        rows = tx.toxicity(odd_docs, lab, F.lit(True)).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert tx.toxicity(no_docs, labels, F.lit(None).cast("boolean")).count() == 0


def test_held_out_labels_leave_every_score(spark):
    rnd = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choice(words, 12)) + (" foul" * 3 if i % 4 == 0 else "")) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache()
    held = lambda i: i % 5 == 0
    train = [(i, int(i % 4 == 0)) for i, _ in docs if not held(i)]

    def scores(labels):
        return {r.doc_id: r.score for r in tx.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0).collect()}

    want = scores(train)
    assert len(want) == 240 and len(set(want.values())) > 1
    for y in (0, 1):  # labels of held-out documents, of ids without a document and of no id
        assert scores(train + [(i, y) for i, _ in docs if held(i)] + [(1000 + i, y) for i in range(400)] + [(None, y)]) == want
    one = [(i, 1) for i, y in train if y] + [(i, 0) for i, _ in docs if held(i)]  # no network: the share of training labels
    assert set(scores(one).values()) == {1.0} and set(scores([(i, 1) for i, _ in docs if held(i)]).values()) == {0.0}

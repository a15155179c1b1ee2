"""Operator 6, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read in overlapping windows of ``LENGTH`` words, ``STEP`` apart. A word's input is its own vector (words of
the training sample's vocabulary), its evidence (log odds of its document frequency in toxic and other training texts)
and the mean vector of its byte trigrams, so unseen spellings have an input too. Two gated recurrent layers read a
window in both directions, attention pools their states, a logit comes out; a text's logit is the largest of its
windows, and a logistic fit on the training texts turns it into the score.

The network is fitted on the driver on a bounded sample: at most ``PER_CLASS`` labelled texts of either class, those
with the least hash of their id, of at most ``LONGEST`` bytes. Of a toxic text the window with the strongest evidence
is a positive example, of others that window and random ones are negative. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordlake.llm import textblocks as tb
from wordlake.session import cut_lineage

LENGTH, STEP = 32, 16
PER_CLASS, LONGEST = 4000, 64 << 10
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
TRIGRAMS = 1 << 12
VOCABULARY = 20_000
EPOCHS, BATCH, RATE = 4, 256, 0.01


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word within the row) of the windows of rows with so many words; an empty row has one empty window."""
    n = np.maximum(1, -(-np.maximum(count - STEP, 0) // STEP))
    row = np.repeat(np.arange(len(count)), n)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STEP


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def trigrams(w: tb.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the byte trigrams of the words ``at``, with an end mark on both sides; how many each has)."""
    size = (w.end - w.start)[at]
    reach = size + 2
    begin = np.cumsum(reach) - reach
    flat = np.zeros(int(reach.sum()) + 2, np.int64)
    inner = np.repeat(begin + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    flat[inner] = w.data[np.repeat(w.start[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    code = flat[place] << 16 | flat[place + 1] << 8 | flat[place + 2]
    return (tb.mix(code.astype(tb.U64)) % tb.U64(TRIGRAMS)).astype(np.int64), size


@dataclass
class Network:
    hashes: np.ndarray  # of the vocabulary, sorted
    evidence: np.ndarray  # of the vocabulary, then one 0 for other words
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def new(cls, hashes, evidence, seed: int = 5) -> Network:
        rnd = np.random.default_rng(seed)
        dim = WORD_DIM + 1 + CHAR_DIM
        make = lambda *s: (rnd.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        p = {"word": make(len(hashes) + 1, WORD_DIM) * 0.1, "char": make(TRIGRAMS, CHAR_DIM) * 5, "out": np.zeros(2 * HIDDEN, np.float32), "bias": np.zeros(1, np.float32),
             "att": make(2 * HIDDEN, HIDDEN), "query": np.zeros(HIDDEN, np.float32)}
        for d in "fb":
            p |= {f"in_{d}": make(dim, 3 * HIDDEN), f"rec_{d}": make(HIDDEN, 3 * HIDDEN), f"b_{d}": np.zeros(3 * HIDDEN, np.float32)}
        p["out"] = make(2 * HIDDEN, 1)[:, 0]
        return cls(hashes, evidence.astype(np.float32), p)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))

    def inputs(self, index, grams, size) -> np.ndarray:
        """Input of distinct words, and of no word as the last row."""
        end = np.cumsum(size)
        total = np.concatenate((np.zeros((1, CHAR_DIM), np.float32), np.cumsum(self.p["char"][grams], 0, dtype=np.float64)))
        mean = ((total[end] - total[end - size]) / np.maximum(size, 1)[:, None]).astype(np.float32)
        x = np.concatenate((self.p["word"][index], self.evidence[index][:, None], mean), 1)
        return np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))

    def forward(self, x: np.ndarray, ids: np.ndarray, held: dict | None = None) -> np.ndarray:
        """Logits of windows; ``ids`` (window, place) are rows of ``x``, its last row where no word is."""
        real = ids < len(x) - 1
        states = []
        for d in "fb":
            proj, rec = x @ self.p[f"in_{d}"] + self.p[f"b_{d}"], self.p[f"rec_{d}"]
            h = np.zeros((len(ids), HIDDEN), np.float32)
            out = np.zeros((ids.shape[1], len(ids), HIDDEN), np.float32)
            steps = []
            for t in range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1):
                a, u = proj[ids[:, t]], h @ rec
                zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                if held is not None:
                    steps.append((t, z, r, n, h, u[:, 2 * HIDDEN :]))
                h = np.where(real[:, t, None], n + z * (h - n), h)
                out[t] = h
            states.append(out)
            if held is not None:
                held[d] = steps
        h = np.concatenate(states, 2)
        e = np.tanh(h @ self.p["att"])
        score = np.where(real.T, e @ self.p["query"], -1e9)
        w = np.exp(score - score.max(0)) * real.T
        w /= np.maximum(w.sum(0), 1e-9)
        pool = (w[:, :, None] * h).sum(0)
        if held is not None:
            held |= {"real": real, "h": h, "e": e, "w": w, "pool": pool}
        return pool @ self.p["out"] + self.p["bias"][0]

    def gradient(self, x, ids, index, grams, size, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the loss by all parameters, from its slope by each window's logit."""
        held: dict = {}
        self.forward(x, ids, held)
        h, e, w, real = held["h"], held["e"], held["w"], held["real"]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = slope @ held["pool"], np.array([slope.sum()], np.float32)
        dpool = slope[:, None] * self.p["out"]
        dh = w[:, :, None] * dpool
        dw = (h * dpool).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        g["query"] = np.einsum("tb,tbk->k", ds, e)
        de = ds[:, :, None] * self.p["query"] * (1 - e * e)
        g["att"] = np.einsum("tbi,tbk->ik", h, de)
        dh = dh + de @ self.p["att"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            rec, back = self.p[f"rec_{d}"], np.zeros((len(ids), HIDDEN), np.float32)
            flow = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, z, r, n, before, un in reversed(held[d]):
                keep = real[:, t, None]
                total = back + dh[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dz, dn = total * (before - n) * z * (1 - z), total * (1 - z) * (1 - n * n)
                du = np.concatenate((dz, dn * un * r * (1 - r), dn * r), 1) * keep
                da = np.concatenate((du[:, : 2 * HIDDEN], dn * keep), 1)
                np.add.at(flow, ids[:, t], da)
                g[f"rec_{d}"] += before.T @ du
                back = np.where(keep, total * z, total) + du @ rec.T
            g[f"in_{d}"], g[f"b_{d}"] = x.T @ flow, flow.sum(0)
            dx += flow @ self.p[f"in_{d}"].T
        dx = dx[:-1]
        np.add.at(g["word"], index, dx[:, :WORD_DIM])
        np.add.at(g["char"], grams, np.repeat(dx[:, WORD_DIM + 1 :] / np.maximum(size, 1)[:, None], size, 0))
        return g

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest window logit of each row of a block."""
        rows = len(offsets) - 1
        w = tb.words(data, offsets, lower=True)
        _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        x = self.inputs(self.index(w.hash[first]), *trigrams(w, first))
        row, ids = window_ids(w, inverse, rows, len(first))
        found = np.concatenate([self.forward(x, ids[i : i + 8192]) for i in range(0, len(ids), 8192)])
        return np.maximum.reduceat(found, np.searchsorted(row, np.arange(rows)))

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * logits.astype(float) + self.scale[1])


def window_ids(w: tb.Words, ids: np.ndarray, rows: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, ids of the words) of all windows; ``none`` where a window has no word."""
    count = np.bincount(w.row, minlength=rows)
    row, first = windows(count)
    place = first[:, None] + np.arange(LENGTH)
    at = (np.cumsum(count) - count)[row][:, None] + place
    inside = place < count[row][:, None]
    return row, np.where(inside, np.append(ids, none)[np.where(inside, at, len(ids))], none)


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 5) -> Network:
    """Fit on texts and their labels; ``scale`` is left to ``calibrate``."""
    rnd = np.random.default_rng(seed)
    seen = []
    for lo, hi, data, offsets in tb.blocks(texts):
        w = tb.words(data, offsets, lower=True)
        seen.append((lo, hi, w))
    pairs = [np.unique(np.stack((w.row.astype(tb.U64) + tb.U64(lo), w.hash)), axis=1) for lo, _, w in seen]
    doc, value = np.concatenate([p[0] for p in pairs]).astype(np.int64), np.concatenate([p[1] for p in pairs])
    hashes, inverse, df = np.unique(value, return_inverse=True, return_counts=True)
    bad = np.bincount(inverse, weights=toxic[doc], minlength=len(hashes))
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((df - bad + 0.5) / (n0 + 1))
    common = np.sort(np.argsort(-df, kind="stable")[:VOCABULARY])
    common = common[df[common] >= 5]
    net = Network.new(hashes[common], np.append(odds[common], 0.0), seed)
    examples, labels = [], []
    vocabulary: list[np.ndarray] = []
    grams, sizes, shift = [], [], 0
    for lo, hi, w in seen:
        value, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        t, s = trigrams(w, first)
        row, ids = window_ids(w, inverse, hi - lo, len(first))
        proof = np.append(net.evidence[net.index(value)], 0.0)[ids].max(1)
        pick = np.lexsort((-proof, row))
        best = pick[np.searchsorted(row[pick], np.arange(hi - lo))]
        y = toxic[lo:hi]
        other = np.flatnonzero((y[row] == 0) & (rnd.random(len(row)) < np.minimum(1, 3 / np.bincount(row, minlength=hi - lo)[row])))
        use = np.concatenate((best, other))
        ids = ids[use]
        examples.append(np.where(ids == len(first), -1, ids + shift))
        labels.append(y[row[use]])
        vocabulary.append(net.index(value))
        grams.append(t)
        sizes.append(s)
        shift += len(first)
    ids, y = np.concatenate(examples), np.concatenate(labels).astype(np.float32)
    index, size = np.concatenate(vocabulary), np.concatenate(sizes)
    gram, begin = np.concatenate(grams), np.cumsum(size) - size
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    m, v, step = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0
    for _ in range(EPOCHS):
        order = rnd.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            used, local = np.unique(ids[at], return_inverse=True)
            local = local.reshape(len(at), LENGTH)
            if used[0] < 0:
                used, local = used[1:], np.where(local == 0, len(used) - 1, local - 1)
            n = size[used]
            g = gram[np.repeat(begin[used] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            x = net.inputs(index[used], g, n)
            slope = ((_sigmoid(net.forward(x, local)) - y[at]) * weight[at] / len(at)).astype(np.float32)
            grad = net.gradient(x, local, index[used], g, n, slope)
            step += 1
            for k in net.p:
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.01 * (grad[k] ** 2 - v[k])
                net.p[k] = (net.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def calibrate(net: Network, logits: np.ndarray, toxic: np.ndarray, share: float) -> Network:
    """Logistic fit of the texts' logits, the classes weighted to a ``share`` of toxic texts."""
    w = np.where(toxic == 1, share / max(1, toxic.sum()), (1 - share) / max(1, (1 - toxic).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * logits + b)
        r, s = w * (p - toxic), w * p * (1 - p) + 1e-9
        g = np.array([(r * logits).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(s * logits**2).sum() + 1e-3, (s * logits).sum()], [(s * logits).sum(), s.sum()]])
        da, db = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - np.clip(da, -0.5, 0.5), b - np.clip(db, -1, 1)
    net.scale = (float(max(a, 0.05)), float(b))
    return net


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1) and predicted (1 from 0.5 on).

    ``train_rows`` says of ids which labels may be learnt from (null: not); labels other than 0 and 1, and labels of
    null or unknown ids, are ignored, of contradicting ones the greatest counts. Null texts count as empty ones, which
    have a score as well. Without training labels of both classes every score is the share of toxic ones among all
    labelled ids that may be learnt from, 0 if there are none. Of several texts of one id the least in byte order is learnt
    from. Other columns are not read; a label that may not be
    learnt from, or whose id is in no document, never enters a score.
    """
    label = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train_rows, F.lit(False)).alias("use"))
    known = texts.where("use").select("id", F.octet_length("text").alias("size")).groupBy("id").agg(F.min("size").alias("size")).join(label, "id")
    share = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    few = [known.where((F.col("y") == y) & (F.col("size") <= LONGEST)).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for y in (0, 1)]
    chosen = cut_lineage(few[0].unionByName(few[1]).select("id", "y"))  # 2 * PER_CLASS ids at most, whose texts alone are fetched
    held = texts.where(F.col("use") & (F.octet_length("text") <= LONGEST)).join(F.broadcast(chosen), "id")
    sample = held.groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("y", F.xxhash64("id"), "id").toArrow()
    y = sample.column("y").to_numpy().astype(np.int64) if sample.num_rows else np.zeros(0, np.int64)
    rate = share.get(1, 0) / max(1, sum(share.values()))
    net = None
    if len(np.unique(y)) == 2:
        chunk = sample.column("text").combine_chunks()
        net = train(chunk, y)
        calibrate(net, np.concatenate([net.logits(d, o) for _, _, d, o in tb.blocks(chunk, 1 << 20)]), y, min(max(rate, 0.01), 0.99))
        del chunk
    del sample  # the driver keeps the network, not what its training took
    gc.collect()
    tb._give_back()
    net = docs.sparkSession.sparkContext.broadcast(net)  # VOCABULARY words at most

    def score(batches):
        for batch in batches:
            for lo, hi, data, offsets in tb.blocks(batch.column(1), 2 << 20):
                s = net.value.scores(net.value.logits(data, offsets)) if net.value else np.full(hi - lo, rate)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(score, "doc_id long, score double, predicted int")

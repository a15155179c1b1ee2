"""Operator 1 against counts and the word recursion in plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from wordlake.llm import lm_scoring
from wordlake.llm import textblocks as tb
from wordlake.llm.lattice import Vocabulary, load_pieces, marginal_of
from wordlake.llm.lm_scoring import lm_scores
from wordlake.llm.queries import LLM_QUERIES, PIECES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def segmentations(span, v):
    """Every segmentation of a word as a list of piece numbers."""
    first, later = v.by_text

    def rest(at):
        if at == len(span):
            yield []
        for end in range(at + 1, len(span) + 1):
            if (p := later.get(span[at:end])) is not None:
                yield from ([p, *tail] for tail in rest(end))

    for end in range(len(span) + 1):
        if (p := first.get(span[:end])) is not None:
            yield from ([p, *tail] for tail in rest(end))


def enumerated(span, v, ways):
    """(log probability without the end, expected uses) by adding up all segmentations; long words by the recursion."""
    if len(span) > 10:
        return marginal_of(span, v, True)
    if span not in ways:
        ways[span] = list(segmentations(span, v))
    each = [math.exp(sum(v.scores[p] for p in way)) for way in ways[span]]
    uses = np.zeros(len(v.pieces))
    for way, x in zip(ways[span], each):
        np.add.at(uses, way, x / sum(each))
    return math.log(sum(each)), uses


def brute(rows, rounds):
    """(doc_id, text, train) -> [(n_tokens, n_known, train_tokens, base, score)]."""
    total, ends = Counter(), 0
    for _, text, train in rows:
        if train:
            total.update(words_of(text))
            ends += 1
    n, types = sum(total.values()) + ends, len(total) + (ends > 0)
    v, ways = Vocabulary(load_pieces(PIECES)), {}
    for _ in range(rounds):
        uses = np.full(len(v.pieces), 0.01)
        for w, c in total.items():
            uses += c * enumerated(w.encode(), v, ways)[1]
        first, later = uses[v.initial].sum(), uses[~v.initial].sum()
        v = Vocabulary(v.pieces, np.log(np.where(v.initial, uses / first, uses / (later + first))))
        v.stop = math.log(first / (later + first))
    seen, out = {}, []
    for _, text, _ in rows:
        w = words_of(text)
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (types + 1))) for c in [*(total[x] for x in w), ends])
        for x in w:
            if x not in seen:
                seen[x] = (enumerated(x.encode(), v, ways)[0] + v.stop) / math.log(10)
        score = math.log10((ends + 1) / (n + 2)) + sum(math.log10((n - ends + 1) / (n + 2)) + seen[x] for x in w)
        out.append((len(w) + 1, sum(total[x] > 0 for x in w) + (ends > 0), n, base, score))
    return out


@pytest.mark.parametrize("known_words,piece,held,batch", [(65_536, 1 << 20, 24 << 20, 8 << 20), (3, 64, 1024, 2000)])
def test_scores_are_all_segmentations(spark, odd_docs, monkeypatch, known_words, piece, held, batch):
    for name, value in (("KNOWN_WORDS", known_words), ("PIECE", piece), ("HELD", held), ("BATCH", batch)):
        monkeypatch.setattr(lm_scoring, name, value)
    extra = spark.read.parquet(f"{SF001}/documents.parquet").limit(25)
    docs = odd_docs.unionByName(extra.withColumns({"kept": F.lit(""), "word": F.lit("")}))
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))).collect()
    want = brute([tuple(r) for r in rows], 2)
    got = lm_scores(docs, PIECES, train=F.col("doc_id") % 3 != 0, rounds=2).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1], round(r[5], 4))
    got = sorted(([r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] for r in got), key=key)
    want = sorted(([r[0], *w] for r, w in zip(rows, want)), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_a_long_text_comes_in_pieces_of_whole_words():
    import pyarrow as pa

    texts = ["a b", None, " ".join(f"wort{i}" for i in range(500)), "x" * 900 + " end", "", "last"]
    got = [[] for _ in texts]
    for lo, hi, data, offsets, last in tb.word_pieces(pa.array(texts), 100):
        assert last or hi == lo + 1
        w = tb.words(data, offsets)
        for i, row in enumerate(w.row.tolist()):
            got[lo + row].append(w.text(i).decode())
    assert got == [words_of(t) for t in texts]


def test_no_rows_and_no_training(spark, odd_docs, no_docs):
    assert lm_scores(no_docs, PIECES, train=F.lit(True)).count() == 0
    rows = lm_scores(odd_docs, PIECES, train=F.lit(None).cast("boolean")).collect()
    assert len(rows) == odd_docs.count() and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_the_query(spark):
    rows = LLM_QUERIES["op1_lattice_lm"](spark, SF001).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in words_of(t))
    ends = sum(1 for i in texts if zlib.crc32(str(i).encode()) % 10)
    n = sum(train.values()) + ends
    assert len(rows) == len(texts)
    for r in rows:
        w = words_of(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(w) + 1, sum(x in train for x in w) + 1)
        assert r.base_score == pytest.approx(sum(math.log10((c + 0.1) / (n + 0.1 * (len(train) + 2))) for c in [*(train[x] for x in w), ends]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_fitted_scores_are_better(spark):
    """On texts that were held out, settled scores beat those after one round, and these the vocabulary's order."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    held = [sum(r.score for r in lm_scores(docs, PIECES, train=F.col("doc_id") % 5 != 0, rounds=n).where("doc_id % 5 = 0").collect()) for n in (0, 1, None)]
    assert held[2] > held[1] > held[0]

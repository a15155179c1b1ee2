"""Operators 2, 7 and 9 against plain definitions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import zstandard

from tests.conftest import SF001
from tests.llm.conftest import TEXTS
from wordlake.llm import textblocks as tb
from wordlake.llm.bpe import Ranks, bpe_decode, bpe_encode, pre_tokens
from wordlake.llm.lattice import Vocabulary, best_of, load_pieces, marginal_of
from wordlake.llm.quality import Bands, quality_rules
from wordlake.llm.queries import LLM_QUERIES, PIECES, RANKS
from wordlake.llm.token_counts import token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_hashes_of_long_blocks_need_no_longer_tables():
    """Equal spans have equal hashes before, over and behind the steps of a block, whose length the kept tables don't follow."""
    data = np.random.default_rng(5).integers(0, 256, 3 * tb._STEP + 5).astype(np.uint8)
    start = np.array([0, 7, tb._STEP - 3, tb._STEP, 2 * tb._STEP + 1, len(data) - 4, len(data)])
    end = np.minimum(start + 40, len(data))
    alone = [tb.SpanHash(data[a:b])(np.array([0]), np.array([b - a]))[0] for a, b in zip(start.tolist(), end.tolist())]
    assert tb.SpanHash(data)(start, end).tolist() == alone
    assert sum(t.nbytes for t in tb._power_tables()) <= 5 << 20


def test_quality_base_and_bands(odd_docs, no_docs):
    assert quality_rules(no_docs).count() == 0
    for r, src in zip(quality_rules(odd_docs, keep=["text", "kept"]).collect(), odd_docs.collect(), strict=True):
        n, *_, rep = want = base_counts(src.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, src
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and r.in_text == src.text and r.in_kept == src.kept
        raw = (src.text or "").encode()
        assert r.ratio == pytest.approx(len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw)) if raw else 0)
        assert r.kept == (r.verdict == "ok") and (not r.base_failed or not r.kept)


def test_quality_bands(spark):
    rnd = random.Random(3)
    clean = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(2000))
    noise = "".join(chr(rnd.randint(33, 126)) + (" " if i % 9 == 8 else "") for i in range(9000))
    same = "".join(f"{i % 10} buy this now and win {i} " for i in range(600))
    found = quality_rules(spark.createDataFrame([(1, clean), (2, noise), (3, same)], "doc_id long, text string")).collect()
    assert [(r.verdict in ("ok",), r.verdict) for r in found] == [(True, "ok"), (False, "incompressible"), (False, found[2].verdict)]
    assert found[2].verdict in ("repetitive", "base") and Bands().band(2048)[1] < found[2].ratio


def test_key_dumps_of_every_length(spark):
    rnd = random.Random(62)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = []
    for n in (200, 255, 256, 320, 383, 426, 447, 511, 575, 639, 700, 767, 870, 895, 1000, 1023, 1024, 1500, 2047, 2048, 5000, 9000, 40000):
        size = min(n / 51 - 1, 30)
        for _ in range(20):
            dump = " ".join("".join(rnd.choices(signs, k=max(1, round(rnd.uniform(size - 1, size + 1))))) for _ in range(n))[:n]
            texts += [dump] if len(dump.split()) >= 50 else []
    found = quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(found) > 400 and [(len(texts[r.doc_id]), r.ratio, r.verdict) for r in found if r.verdict != "incompressible"] == []


def test_quality_on_the_table(spark):
    rows = LLM_QUERIES["op2_quality_rules"](spark, SF001).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(texts[r.doc_id])


def test_split_is_the_pattern():
    rnd, find = random.Random(1), regex.compile(public_tokenizers.PATTERN).findall
    letters = list("aZé漢'''strevemlld  \n\t　 123½.,!?-😀\x1c\x85")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(5000)] + TEXTS + ["'s", "a're", " 's", "'ll'll"]
    for lo, hi, data, offsets in tb.blocks(pa.array(texts), 50_000):
        at = [*pre_tokens(data, offsets).tolist(), len(data)]
        cut, raw = [at.index(o) for o in offsets.tolist()], bytes(data)
        for i in range(hi - lo):
            assert [raw[a:b].decode() for a, b in zip(at[cut[i] : cut[i + 1]], at[cut[i] + 1 : cut[i + 1] + 1])] == find(texts[lo + i] or "")


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Ranks(RANKS).rank, special_tokens={})


def test_replay_is_sequential_bpe():
    rnd, table, enc = random.Random(2), Ranks(RANKS), encoding()
    words = [bytes(rnd.choice(b"aaab \n-=e") for _ in range(rnd.randint(1, 40))) for _ in range(3000)] + [b"-" * 3000]
    ids, begin = table.replay(words)
    for i, w in enumerate(words):
        assert ids[begin[i] : begin[i + 1]].tolist() == enc._encode_single_piece(w)
        assert len(w) > 100 or table.one(w) == enc._encode_single_piece(w)


def test_encode_decode(odd_docs, no_docs):
    assert bpe_decode(bpe_encode(no_docs, RANKS), RANKS).count() == 0
    enc = encoding()
    for r, src in zip(bpe_decode(bpe_encode(odd_docs, RANKS), RANKS).collect(), odd_docs.collect(), strict=True):
        raw = (src.text or "").encode()
        assert bytes(r.decoded) == raw and r.n_bytes == len(raw) and r.doc_id == src.doc_id
        assert [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] == enc.encode_ordinary(src.text or "")


def test_bpe_on_the_table(spark):
    enc, texts = encoding(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = LLM_QUERIES["op9_bpe_round_trip"](spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def spellings(word, pieces, first=True):
    """All segmentations, as lists of piece numbers."""
    found = [[i] for i, (text, initial) in enumerate(pieces) if first and initial and text == b""] if first else [[]] if not word else []
    heads = found if first else [[]]
    out = [h for h in heads if not word]
    for i, (text, initial) in enumerate(pieces):
        if text and initial == first and word.startswith(text):
            out += [[i, *rest] for rest in spellings(word[len(text):], pieces, False)]
    if first:
        for head in found:
            out += [[*head, *rest] for rest in spellings(word, pieces, False)] if word else []
    return out


def test_recursions_against_all_segmentations():
    pieces = [(b"", True), (b"a", True), (b"ab", True), (b"a", False), (b"b", False), (b"ab", False), (b"ba", False), (b"c", False)]
    v = Vocabulary(pieces)
    for word in (b"a", b"ab", b"abab", b"cab", b"aabbc", b"bababa"):
        each = spellings(word, pieces)
        scores = [sum(v.scores[i] for i in s) for s in each]
        best, count = best_of(word, v)
        assert best == pytest.approx(max(scores)) and count == min(len(s) for s, x in zip(each, scores) if x == pytest.approx(best))
        import numpy as np
        total, uses = marginal_of(word, v, True)
        assert total == pytest.approx(np.logaddexp.reduce(scores))
        want = sum(np.exp(x - total) * np.bincount(s, minlength=len(pieces)) for s, x in zip(each, scores))
        assert uses == pytest.approx(want)


def test_trie_is_the_word_recursion():
    import numpy as np

    from wordlake.llm.lattice import Trie
    v, words = Vocabulary(load_pieces(PIECES)), sorted({w.encode() for t in TEXTS if t for w in WORD.findall(t)})
    end = np.cumsum([len(w) for w in words])
    trie = Trie(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end)
    (score, count), (total, _) = trie.best(v), trie.forward(v)
    weight, uses = np.arange(1.0, len(words) + 1), np.zeros(len(v.pieces))
    for i, w in enumerate(words):
        assert (score[i], count[i]) == pytest.approx(best_of(w, v)) and total[i] == pytest.approx(marginal_of(w, v)[0])
        uses += weight[i] * marginal_of(w, v, True)[1]
    got, each = trie.expected(v, weight)
    assert got == pytest.approx(uses, abs=1e-6) and each == pytest.approx(total)


def test_token_counts(spark, odd_docs, no_docs):
    v = Vocabulary(load_pieces(PIECES))
    assert token_counts(no_docs, PIECES).count() == 0
    texts = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").limit(30))
    for r, src in zip(token_counts(texts, PIECES, remember=500).collect(), texts.collect(), strict=True):
        each = [best_of(w.encode(), v) for w in WORD.findall(src.text or "")]
        assert (r.n_pretokens, r.n_tokens) == (len(each), sum(c for _, c in each))
        assert r.best_score == pytest.approx(sum(s for s, _ in each))


def test_a_chunk_is_judged_by_its_own_length():
    """A text of one short chunk between the limits of its length and those of a full chunk passes."""
    import random

    import zstandard

    from wordlake.llm.quality import Bands, _compression

    bands, squeeze = Bands(), zstandard.ZstdCompressor(level=3).compress
    rng, met = random.Random(8), 0
    for n in range(1100, 2040, 4):
        raw = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQR") for _ in range(6)) for _ in range(n))[:n].encode()
        ratio, chunks, high, low = _compression(raw, bands, squeeze)
        if bands.band(n)[0] <= ratio < bands.band(bands.chunk_bytes)[0]:
            met += 1
            assert (chunks, high, low) == (1, 0, 0)
    assert met

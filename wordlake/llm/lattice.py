"""Unigram lattices over an existing subword vocabulary, on a trie of distinct words.

A word is its UTF-8 bytes; its first piece is one that starts with the word mark, every later piece is one without it.
Bytes that are no piece of their own get the vocabulary's byte piece, so each word has at least one segmentation.
Words are inserted level by level: a node is a distinct prefix, and what belongs to a prefix is computed once however
many words share it. Words longer than ``LONG_WORD`` bytes would make the trie deep and are worked through one by one
by the same recursion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from wordlake.llm.textblocks import U64, SpanHash

MARK = "▁"
LONG_WORD = 64


def load_pieces(model_path: str) -> list[tuple[bytes, bool]]:
    """(bytes, starts a word) of each usable piece of a sentencepiece model, in the model's order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found, single, spare = [], set(), []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            spare.append(bytes([int(piece[3:5], 16)]))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            initial = piece.startswith(MARK)
            text = piece[len(MARK):] if initial else piece
            if MARK not in text and (text or initial):
                found.append((text.encode(), initial))
                if not initial and len(found[-1][0]) == 1:
                    single.add(found[-1][0])
    return found + [(b, False) for b in spare if b not in single]


class _Table:
    """Hash table from piece hash to piece number, probed with whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(len(keys) * 4).bit_length())
        self.mask, self.key, self.value = U64(size - 1), np.zeros(size, U64), np.full(size, -1, np.int32)
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            at = k & (size - 1)
            while self.value[at] >= 0:
                at = (at + 1) & (size - 1)
            self.key[at], self.value[at] = k, v

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & self.mask).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            value, same = self.value[at], self.key[at] == keys[left]
            out[left[same]] = value[same]
            on = ~same & (value >= 0)
            left, at = left[on], (at[on] + 1) & int(self.mask)
        return out


class Vocabulary:
    """Pieces with natural-log scores; ``scores[i]`` belongs to ``pieces[i]``."""

    def __init__(self, pieces: list[tuple[bytes, bool]], scores=None):
        self.pieces = pieces
        self.initial = np.array([p[1] for p in pieces], bool)
        size = np.array([len(p[0]) for p in pieces])
        end = np.cumsum(size)
        hashes = SpanHash(np.frombuffer(b"".join(p[0] for p in pieces) or b"\0", np.uint8))(end - size, end)
        at = np.arange(len(pieces))
        self.first = _Table(hashes[self.initial], at[self.initial])
        self.later = _Table(hashes[~self.initial], at[~self.initial])
        self.first_sizes = set(size[self.initial].tolist())
        self.later_sizes = sorted(set(size[~self.initial].tolist()))
        self.bare = next((i for i, p in enumerate(pieces) if p == (b"", True)), -1)
        self.by_text = ({p[0]: i for i, p in enumerate(pieces) if p[1]}, {p[0]: i for i, p in enumerate(pieces) if not p[1]})
        self.scores = rank_scores(self.initial) if scores is None else np.asarray(scores, float)
        self.stop = 0.0


def rank_scores(initial: np.ndarray) -> np.ndarray:
    """Scores from the vocabulary's own order, as natural logarithms: 1 / (rank + 2.7), normalised over all pieces."""
    weight = 1 / (np.arange(len(initial)) + 2.7)
    return np.log(weight / weight.sum())


@dataclass
class _Level:
    word: np.ndarray  # a word through each node
    node: np.ndarray  # node number of each of the words that reach this depth


class Trie:
    """Distinct words with the forward recursion over their shared prefixes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, size = data, end - start
        self.order = np.argsort(-size, kind="stable")
        self.long = self.order[: int((size > LONG_WORD).sum())]
        self.kept = self.order[len(self.long):]
        self.start, self.size = start[self.kept], size[self.kept]
        self.spans = [data[start[i] : end[i]].tobytes() for i in self.long]
        self.hash = SpanHash(data)
        self.n_words, self.levels, self.n_nodes = len(start), [], 1
        depth = 0
        while (n := int(np.searchsorted(-self.size, -depth, "right")) if depth else len(self.size)):
            if not depth:
                self.levels.append(_Level(np.zeros(1, np.int64), np.zeros(n, np.int32)))
            else:
                _, word, inverse = np.unique(self.hash(self.start[:n], self.start[:n] + depth), return_index=True, return_inverse=True)
                self.levels.append(_Level(word, (inverse + self.n_nodes).astype(np.int32)))
                self.n_nodes += len(word)
            depth += 1

    def _arcs(self, vocabulary: Vocabulary, depth: int):
        """(index of the node in its level, node before, piece) of the arcs into a level, length by length."""
        word = self.levels[depth].word
        if depth in vocabulary.first_sizes:
            piece = vocabulary.first(self.hash(self.start[word], self.start[word] + depth))
            if len(hit := np.flatnonzero(piece >= 0)):
                yield hit, None, piece[hit]
        for size in vocabulary.later_sizes:
            if size > depth:
                break
            piece = vocabulary.later(self.hash(self.start[word] + depth - size, self.start[word] + depth))
            if len(hit := np.flatnonzero(piece >= 0)):
                yield hit, self.levels[depth - size].node[word[hit]], piece[hit]

    def _leaf(self) -> np.ndarray:
        """The node where each kept word ends."""
        out = np.zeros(len(self.kept), np.int32)
        for depth, level in enumerate(self.levels):
            here = np.flatnonzero(self.size[: len(level.node)] == depth)
            out[here] = level.node[here]
        return out

    def best(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of pieces) of each word's best segmentation; of equal scores the one with fewer pieces."""
        score, count, base = np.full(self.n_nodes, -np.inf), np.zeros(self.n_nodes, np.int32), 0
        for depth, level in enumerate(self.levels):
            n = len(level.word)
            s, c = score[base : base + n], count[base : base + n]
            for hit, before, piece in self._arcs(vocabulary, depth):
                new = vocabulary.scores[piece] + (0 if before is None else score[before])
                pieces = np.ones(len(hit), np.int32) if before is None else count[before] + 1
                better = (new > s[hit]) | (new == s[hit]) & (pieces < c[hit])
                s[hit[better]], c[hit[better]] = new[better], pieces[better]
            base += n
        out, pieces = np.zeros(self.n_words), np.zeros(self.n_words, np.int64)
        leaf = self._leaf()
        out[self.kept], pieces[self.kept] = score[leaf], count[leaf]
        for i, span in zip(self.long, self.spans, strict=True):
            out[i], pieces[i] = best_of(span, vocabulary)
        return out, pieces

    def forward(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(per word, per node): log of the summed probability of all segmentations."""
        total, base = np.full(self.n_nodes, -np.inf), 0
        for depth, level in enumerate(self.levels):
            here = total[base : base + len(level.word)]
            for hit, before, piece in self._arcs(vocabulary, depth):
                here[hit] = np.logaddexp(here[hit], vocabulary.scores[piece] + (0 if before is None else total[before]))
            base += len(level.word)
        out = np.zeros(self.n_words)
        out[self.kept] = total[self._leaf()]
        for i, span in zip(self.long, self.spans, strict=True):
            out[i] = marginal_of(span, vocabulary)[0]
        return out + vocabulary.stop, total

    def expected(self, vocabulary: Vocabulary, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected number of uses of each piece when word i occurs ``weight[i]`` times, ``forward`` per word).

        The derivative of the summed log probabilities by each score, carried from the leaves to the root.
        """
        each, total = self.forward(vocabulary)
        share = np.bincount(self._leaf(), weights=weight[self.kept], minlength=self.n_nodes)
        uses, base = np.zeros(len(vocabulary.pieces)), self.n_nodes
        for depth in range(len(self.levels) - 1, -1, -1):
            n = len(self.levels[depth].word)
            base -= n
            for hit, before, piece in self._arcs(vocabulary, depth):
                at = base + hit
                part = share[at] * np.exp(vocabulary.scores[piece] + (0 if before is None else total[before]) - total[at])
                uses += np.bincount(piece, weights=part, minlength=len(uses))
                if before is not None:
                    low = int(before.min())
                    share[low : int(before.max()) + 1] += np.bincount(before - low, weights=part)
        for i, span in zip(self.long, self.spans, strict=True):
            if weight[i]:
                uses += weight[i] * marginal_of(span, vocabulary, True)[1]
        return uses, each


def _steps(span: bytes, vocabulary: Vocabulary, end: int):
    first, later = vocabulary.by_text
    if end in vocabulary.first_sizes and (piece := first.get(span[:end])) is not None:
        yield None, piece
    for size in vocabulary.later_sizes:
        if size > end:
            break
        if (piece := later.get(span[end - size : end])) is not None:
            yield end - size, piece


def best_of(span: bytes, vocabulary: Vocabulary) -> tuple[float, int]:
    """The recursion of ``Trie.best`` for one word."""
    at: list[tuple[float, int]] = []
    for end in range(len(span) + 1):
        at.append(max(((float(vocabulary.scores[p]) + (0 if b is None else at[b][0]), -1 if b is None else at[b][1] - 1)
                       for b, p in _steps(span, vocabulary, end)), default=(-math.inf, 0)))
    return at[-1][0], -at[-1][1]


def marginal_of(span: bytes, vocabulary: Vocabulary, uses: bool = False) -> tuple[float, np.ndarray | None]:
    """The recursion of ``Trie.forward`` for one word, and the expected uses of the pieces if asked for."""
    total = []
    for end in range(len(span) + 1):
        parts = [float(vocabulary.scores[p]) + (0 if b is None else total[b]) for b, p in _steps(span, vocabulary, end)]
        top = max(parts, default=-math.inf)
        total.append(top + math.log(sum(math.exp(x - top) for x in parts)) if top > -math.inf else -math.inf)
    if not uses:
        return total[-1], None
    found, share = np.zeros(len(vocabulary.pieces)), [0.0] * len(span) + [1.0]
    for end in range(len(span), -1, -1):
        for b, p in _steps(span, vocabulary, end) if share[end] else ():
            part = share[end] * math.exp(float(vocabulary.scores[p]) + (0 if b is None else total[b]) - total[end])
            found[p] += part
            if b is not None:
                share[b] += part
    return total[-1], found

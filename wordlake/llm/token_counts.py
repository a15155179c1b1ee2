"""Operator 7, token counts: trie-shared dynamic programming over an existing unigram vocabulary.

The distinct pre-tokens of a task (``[^\\x20\\x09-\\x0D]+``) go into a trie; the best-segmentation recursion runs once
per node, that is once per shared prefix, and each word's count is read at its terminal node. A task remembers the
counts of words already seen, up to ``remember`` words, so that a word is worked out again only after that many others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordlake.llm import textblocks as tb
from wordlake.llm.lattice import Trie, Vocabulary, load_pieces

FIELDS = "doc_id long, n_pretokens long, n_tokens long, best_score double"
_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file with scores from their order, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(load_pieces(path))
    return _loaded[path]


class _Seen:
    """Word hash -> (pieces, score), sorted by hash."""

    def __init__(self):
        self.hash, self.pieces, self.score = np.zeros(0, tb.U64), np.zeros(0, np.int64), np.zeros(0)

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return self.hash[at] != hashes

    def add(self, hashes, pieces, score) -> None:
        hashes = np.concatenate((self.hash, hashes))
        order = np.argsort(hashes, kind="stable")
        self.hash = hashes[order]
        self.pieces, self.score = np.concatenate((self.pieces, pieces))[order], np.concatenate((self.score, score))[order]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", remember: int = 1_000_000) -> DataFrame:
    """Number of pieces of every row's text by its words' best segmentations, and the sum of their scores; no shuffle.

    Null and empty texts, and texts of white space alone, have 0 tokens. Of segmentations with equal scores the one
    with fewer pieces counts. Rows are judged one by one, repeated ids included; other columns are not read.
    ``model_path`` must exist on the executors.
    """

    def count(batches):
        vocab, seen = vocabulary(model_path), _Seen()
        for batch in batches:
            for lo, hi, data, offsets in tb.blocks(batch.column(1)):
                rows, w = hi - lo, tb.words(data, offsets)
                value, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                new = seen.unknown(value)
                if len(seen.hash) + int(new.sum()) > max(remember, len(value)):
                    seen, new = _Seen(), np.ones(len(value), bool)
                at = first[new]
                score, pieces = Trie(w.data, w.start[at], w.end[at]).best(vocab)
                seen.add(value[new], pieces, score)
                known = np.searchsorted(seen.hash, value)[inverse]
                sums = [np.bincount(w.row, weights=x, minlength=rows) for x in (np.ones(len(w.row)), seen.pieces[known], seen.score[known])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows).cast(pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(np.float64))],
                    names=[f.split()[0] for f in FIELDS.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(count, FIELDS)

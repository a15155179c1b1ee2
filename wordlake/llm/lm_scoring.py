"""Operator 1, LM scoring: subword lattice likelihood.

A word's probability is the summed probability of all its segmentations into pieces of an existing unigram vocabulary
(log-space forward recursion on a trie, see ``lattice``); a document's is the product over its words and its end. The
vocabulary's scores start from its own order and are fitted by rounds of expected piece counts over the training
tokens, until a round raises their likelihood by no more than ``SETTLE`` of itself. Nothing else enters a score.

Three passes, all by word hash blocks whose number follows the text's size:

1. tasks count their distinct words, blocks add the counts up: the word table (written once);
2. blocks of the word table give expected piece counts, added up by piece, once a round;
3. tasks send batches of (row, word hash) to the words' blocks, which return sums by row, packed as one row for each
   batch; a batch's rows meet its sums by the batch's number. The most frequent words, at most
   ``KNOWN_WORDS`` (a power-of-two count from which on there are no more), are broadcast with their probabilities
   instead, so no block gets a word that a fixed share of all rows hold.

Memory: a text is walked in pieces of ``PIECE`` bytes cut between words, so a very long text costs no more than a short
one (a single longer word is taken whole). A task sends its words on when it holds ``HELD`` bytes of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordlake.llm import textblocks as tb
from wordlake.llm.lattice import Trie, Vocabulary, load_pieces
from wordlake.session import cut_lineage

KNOWN_WORDS = 65_536
BLOCK_TEXT = 48 << 20
PIECE = 1 << 20
HELD = 24 << 20
#: Bytes of hashes and sums that a task sends on together.
BATCH = 8 << 20
SETTLE = 0.002
_COUNTS = np.dtype("<i8")


def block_count(docs: DataFrame, text_col: str, per_block: int) -> int:
    """Blocks of about ``per_block`` bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(4, math.ceil(total / per_block))


def _blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[i] ... begin[i] + size[i] - 1, one run after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Counts:
    """Distinct words by hash with their counts."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, data, start, end, hashes, counts) -> None:
        size = end - start
        self.parts.append((hashes, counts, size, data[_runs(start, size)]))
        if len(self.parts) >= 8:
            self.parts = [self.merged()]

    def held(self) -> int:
        """Bytes of all arrays."""
        return sum(x.nbytes for part in self.parts for x in part)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, count, size, bytes), in order of the hash."""
        if not self.parts:
            return np.zeros(0, tb.U64), np.zeros(0, _COUNTS), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        hashes, counts, size, data = (np.concatenate(x) for x in zip(*self.parts))
        value, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(value)).astype(_COUNTS)
        kept = size[first]
        return value, total, kept, data[_runs((np.cumsum(size) - size)[first], kept)]


PART = "block int, hash binary, counts binary, size binary, bytes binary"
WORDS = PART + ", n_types long, n_words long, n_many array<long>"


def _rows(blocks: int, merged) -> pa.RecordBatch:
    """One row for each block with words."""
    value, total, size, data = merged
    of = (value % tb.U64(blocks)).astype(np.int64)
    begin = np.cumsum(size) - size
    order = np.argsort(of, kind="stable")
    present, first = np.unique(of[order], return_index=True)
    out: list[list] = [[] for _ in range(5)]
    for b, at in zip(present.tolist(), np.split(order, first[1:])):
        for column, x in zip(out, (b, _blob(value[at]), _blob(total[at]), _blob(size[at].astype("<i4")), data[_runs(begin[at], size[at])].tobytes())):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int32(), *[pa.binary()] * 4])], names=[f.split()[0] for f in PART.split(", ")])


def _words_of(size: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the words of one row of the word table."""
    n = np.frombuffer(size, "<i4").astype(np.int64)
    end = np.cumsum(n)
    return np.frombuffer(data, np.uint8), end - n, end


def word_table(docs: DataFrame, blocks: int) -> DataFrame:
    """One row a block: the distinct words of ``docs`` (text, train) with their training counts."""

    def count(batches):
        found = _Counts()
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets, _ in tb.word_pieces(batch.column(0), PIECE):
                w = tb.words(data, offsets, lower=True)
                value, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                counts = np.bincount(inverse, weights=train[lo:hi][w.row], minlength=len(value)).astype(_COUNTS)
                found.add(w.data, w.start[first], w.end[first], value, counts)
                if found.held() > HELD:
                    found.parts = [found.merged()]
                    if found.held() > HELD // 2:
                        yield _rows(blocks, found.parts[0])
                        found = _Counts()
        if found.parts:
            yield _rows(blocks, found.merged())

    def reduce(table: pa.Table) -> pa.Table:
        found = _Counts()
        for h, c, s, b in zip(*(table.column(k).to_pylist() for k in ("hash", "counts", "size", "bytes"))):
            found.parts.append((np.frombuffer(h, tb.U64), np.frombuffer(c, _COUNTS), np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(b, np.uint8)))
        value, total, size, data = found.merged()
        row = (table.column("block")[0].as_py(), _blob(value), _blob(total), _blob(size.astype("<i4")), data.tobytes(),
               int((total > 0).sum()), int(total.sum()), [int((total >= 1 << j).sum()) for j in range(48)])
        kinds = (pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 2, pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[f.split()[0] for f in WORDS.split(", ")])

    return docs.mapInArrow(tb.trimmed(count), PART).groupBy("block").applyInArrow(tb.trimmed_group(reduce), WORDS)


def refitted(vocabulary: Vocabulary, uses: np.ndarray) -> Vocabulary:
    """The vocabulary with scores from expected uses of its pieces.

    First pieces have one distribution; a later place holds a piece or the word's end. 0.01 is added to every count.
    """
    uses = uses + 0.01
    words, later = uses[vocabulary.initial].sum(), uses[~vocabulary.initial].sum()
    new = Vocabulary(vocabulary.pieces, np.log(np.where(vocabulary.initial, uses / words, uses / (later + words))))
    new.stop = math.log(words / (later + words))
    return new


def fitted(words: DataFrame, vocabulary: Vocabulary, rounds: int | None = None) -> Vocabulary:
    """The vocabulary with scores fitted to the training tokens: so many rounds, or (None) until they settle."""
    before, done = None, 0
    while rounds is None or done < rounds:
        def expect(batches, v=vocabulary):
            for batch in batches:
                total, log = np.zeros(len(v.pieces)), 0.0
                for c, s, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    count = np.frombuffer(c, _COUNTS).astype(float)
                    data, start, end = _words_of(s, b)
                    if (seen := np.flatnonzero(count)).size:
                        uses, each = Trie(data, start[seen], end[seen]).expected(v, count[seen])
                        total += uses
                        log += float(each @ count[seen])
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], log))], names=["piece", "uses"])

        # as many rows as the vocabulary has pieces, whatever the corpus; row -1 is the log likelihood
        found = words.select("counts", "size", "bytes").mapInArrow(tb.trimmed(expect), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses, log = np.zeros(len(vocabulary.pieces)), 0.0
        for r in found:
            if r.piece < 0:
                log = r.uses
            else:
                uses[r.piece] = r.uses
        if before is not None and rounds is None and log - before <= SETTLE * abs(log):
            break
        before, vocabulary, done = log, refitted(vocabulary, uses), done + 1
    return vocabulary


class Model:
    """Probabilities of tokens, the same on all tasks."""

    def __init__(self, vocabulary: Vocabulary, n_words: int, n_docs: int, n_types: int):
        self.vocabulary, self.ends = vocabulary, n_docs
        self.tokens = float(n_words + n_docs)
        self.types = n_types + (n_docs > 0)
        #: log10 probability that a token is an end, or a word; 1 is added to both counts.
        self.end, self.word = math.log10((n_docs + 1) / (self.tokens + 2)), math.log10((n_words + 1) / (self.tokens + 2))

    def base(self, total: np.ndarray) -> np.ndarray:
        return np.log10((total + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def block(self, row: dict, least: int, below: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, count, log10 probability) of the words of a row of the word table with counts below ``least`` or the others."""
        total = np.frombuffer(row["counts"], _COUNTS)
        pick = np.flatnonzero((total < least) == below)
        data, start, end = _words_of(row["size"], row["bytes"])
        lattice, _ = Trie(data, start[pick], end[pick]).forward(self.vocabulary)
        return np.frombuffer(row["hash"], tb.U64)[pick], total[pick], lattice / math.log(10) + self.word


SUMS = "key long, doc_id long, n_tokens long, n_known long, base double, score double"
SENT = "block int, first long, turn int, at binary, hash binary, own binary"
FOUND = "first long, turn int, rows binary, known binary, base binary, score binary, own binary"
_SUMS = pa.schema([(f.split()[0], {"long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in SUMS.split(", ")])


def _sums(key, doc_id, row, total, n_tokens, base, score) -> pa.RecordBatch:
    """Sums by row over the tokens at ``row``; ``n_tokens`` is given by row."""
    n = len(key)
    add = lambda x: pa.array(np.bincount(row, weights=x, minlength=n).astype(float))
    known = np.bincount(row, weights=total > 0, minlength=n).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), doc_id, pa.array(n_tokens.astype(np.int64)), pa.array(known), add(base), add(score)], schema=_SUMS)


def lm_scores(docs: DataFrame, model_path: str, train: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    ``train`` says which rows are learnt from (null: not); ``rounds`` is the number of fitting rounds, None until the
    scores settle. A null or empty text is its end alone. Rows are scored one by one, repeated ids and null ids
    included; other columns are not read. With no training rows all pieces are equally likely and no word is known.
    """
    train = F.coalesce(train, F.lit(False))
    blocks = block_count(docs, text_col, BLOCK_TEXT)
    words = cut_lineage(word_table(docs.select(F.col(text_col), train.alias("train")), blocks))
    per = words.agg(F.sum("n_types").alias("types"), F.sum("n_words").alias("words"), *(F.sum(F.element_at("n_many", j + 1)).alias(f"m{j}") for j in range(48))).first()
    model = Model(fitted(words, Vocabulary(load_pieces(model_path)), rounds), per["words"] or 0, docs.where(train).count(), per["types"] or 0)
    least = next(1 << j for j in range(48) if (per[f"m{j}"] or 0) <= KNOWN_WORDS)

    def frequent(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([_blob(x)], pa.binary()) for x in model.block(row, least, False)], names=["hash", "total", "logs"])

    words = words.select("block", "hash", "counts", "size", "bytes")
    top = words.mapInArrow(tb.trimmed(frequent), "hash binary, total binary, logs binary").collect()  # KNOWN_WORDS words at most
    known = [np.concatenate([np.zeros(0, t), *(np.frombuffer(r[k], t) for r in top)]) for k, t in enumerate((tb.U64, _COUNTS, float))]
    order = np.argsort(known[0])
    known = docs.sparkSession.sparkContext.broadcast([x[order] for x in known])

    def send(batches):
        value, total, logs = known.value
        own, rows, hashes, first, turn = [], [], [], 0, 0

        def flush():
            """One row for each block with words to look up, and the rest of the sums in one of them."""
            sink, row, value = pa.BufferOutputStream(), np.concatenate(rows), np.concatenate(hashes)
            with pa.ipc.new_stream(sink, _SUMS) as writer:
                for part in own:
                    writer.write_batch(part)
            of = (value % tb.U64(blocks)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            filled = np.union1d(of, [turn % blocks])
            picked = [order[a:b] for a, b in zip(np.searchsorted(of[order], filled, "left"), np.searchsorted(of[order], filled, "right"))]
            return pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int32()), pa.array([first] * len(filled), pa.int64()), pa.array([turn] * len(filled), pa.int32()), pa.array([_blob(row[p].astype("<i4")) for p in picked], pa.binary()),
                 pa.array([_blob(value[p]) for p in picked], pa.binary()), pa.array([sink.getvalue().to_pybytes() if b == turn % blocks else None for b in filled], pa.binary())],
                names=[f.split()[0] for f in SENT.split(", ")])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, data, offsets, last in tb.word_pieces(batch.column(2), PIECE):
                n, w = hi - lo, tb.words(data, offsets, lower=True)
                at = np.minimum(np.searchsorted(value, w.hash), max(0, len(value) - 1))
                held = value[at] == w.hash if len(value) else np.zeros(len(w.hash), bool)
                row, at = w.row[held], at[held]
                ends = n if last else 0  # the end of a text in pieces stands in its last one
                counts = np.append(total[at], np.full(ends, model.ends))
                first = first if own else int(keys[lo])
                rows.append(sum(map(len, own)) + w.row[~held])
                hashes.append(w.hash[~held])
                own.append(_sums(keys[lo:hi], batch.column(1).slice(lo, n), np.append(row, np.arange(ends)), counts, np.bincount(w.row, minlength=n) + last, model.base(counts),
                                 np.append(logs[at], np.full(ends, model.end))))
                if sum(x.nbytes for x in [*hashes, *own]) > BATCH:
                    yield flush()
                    own, rows, hashes, turn = [], [], [], turn + 1
        if own:
            yield flush()

    def add(sent: pa.Table, held: pa.Table) -> pa.Table:
        value, total, logs = next((model.block(row, least, True) for row in held.to_pylist()), (np.zeros(0, tb.U64), np.zeros(0, _COUNTS), np.zeros(0)))
        out = []
        for i in range(sent.num_rows):
            row = sent.slice(i, 1).to_pylist()[0]
            at, of = np.searchsorted(value, np.frombuffer(row["hash"], tb.U64)), np.frombuffer(row["at"], "<i4")
            rows, of = np.unique(of, return_inverse=True)
            by_row = lambda x: _blob(np.bincount(of, weights=x, minlength=len(rows)))  # noqa: E731, B023
            out.append((row["first"], row["turn"], _blob(rows), by_row(total[at] > 0), by_row(model.base(total[at])), by_row(logs[at]), row["own"]))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    def whole(table: pa.Table) -> pa.Table:
        own = pa.ipc.open_stream(next(x for x in table.column("own").to_pylist() if x)).read_all()
        sums = [own.column(k).to_numpy().astype(float) for k in ("n_known", "base", "score")]
        for row in table.to_pylist():
            rows = np.frombuffer(row["rows"], "<i4")
            for x, more in zip(sums, ("known", "base", "score")):
                x[rows] += np.frombuffer(row[more])
        return pa.Table.from_arrays([*own.columns[:3], pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=_SUMS)

    sent = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tb.trimmed(send), SENT)
    found = sent.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(tb.trimmed_cogroup(add), FOUND)
    parts = found.groupBy("first", "turn").applyInArrow(tb.trimmed_group(whole), SUMS)
    sums = parts.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                    F.sum("base").alias("base_score"), F.sum("score").alias("score"))  # a very long text has several parts
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score")

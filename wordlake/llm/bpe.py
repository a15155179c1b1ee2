"""Operator 9, byte-level BPE encoding and decoding: merge replay over a dictionary of pre-tokens.

A task gathers the distinct pre-tokens of its texts and lays their bytes out as linked symbols. An inverted index goes
from each mergeable pair (by the rank of what it makes) to the positions where it stands; ranks are replayed in rising
order, each for all its positions at once, and only the pairs beside a merge are looked up again. A merge may open a
pair of lower rank in its word; a sequential encoder would take that one before any later merge, so such words are
encoded again one by one. Texts become runs of dictionary entries, their ids and bytes are gathered with arrays.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wordlake.llm import textblocks as tb
from wordlake.llm.lattice import _Table

BLOCK_BYTES = 16 << 20
#: Of these, so much is split and hashed at once.
PART_BYTES = 1 << 20


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size) one after the other."""
    total = int(sizes.sum())
    shift = starts - (np.cumsum(sizes) - sizes)
    return np.repeat(shift, sizes) + np.arange(total)


def _joined(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in runs], np.int64)
    return np.frombuffer(b"".join(runs), np.uint8), np.concatenate(([0], np.cumsum(size)))


class Ranks:
    """A rank file: one token a line, base64 and rank; a token's rank is its id and the order of its merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for token, r in self.rank.items():
            self.token[r] = token
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(r)
        self._pairs = _Table(tb.mix(np.array(keys, tb.U64)), np.array(values))
        self.bytes, self.begin = _joined(self.token)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two neighbours make, -1 if they make nothing."""
        return self._pairs(tb.mix(left.astype(tb.U64) << tb.U64(32) | right.astype(tb.U64)))

    def one(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank first, of equal ranks the leftmost."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            made = [self.rank.get(a + b, len(self.token)) for a, b in zip(parts, parts[1:])]
            if (low := min(made)) == len(self.token):
                break
            at = made.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, offsets of the words in them)."""
        data, begin = _joined(words)
        n = len(data)
        word = np.repeat(np.arange(len(words)), np.diff(begin))
        symbol = self.byte[data]
        after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        filled = np.diff(begin) > 0
        after[begin[1:][filled] - 1] = -1
        before[begin[:-1][filled]] = -1
        made = np.full(n, -1, np.int32)
        pairs = np.flatnonzero(after >= 0)
        made[pairs] = self.pair(symbol[pairs], symbol[pairs + 1])
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            at = at[np.argsort(made[at], kind="stable")]
            ranks, first = np.unique(made[at], return_index=True)
            for r, positions in zip(ranks.tolist(), np.split(at, first[1:])):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(positions)

        queue: list[int] = []
        enter(np.flatnonzero(made >= 0))
        again: set[int] = set()
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[made[at] == r]
            if not len(at):
                continue
            # of occurrences that share a symbol (aaa) every second one, from the left
            linked = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if linked.any():
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(linked, 0, place))
                at = at[(place - run) % 2 == 0]
            right = after[at]
            beyond = after[right]
            symbol[at], symbol[right], made[right], after[at] = r, -1, -1, beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            touched = np.unique(np.concatenate((left[left >= 0], at)))
            ends = after[touched] < 0
            made[touched[ends]] = -1
            touched = touched[~ends]
            made[touched] = self.pair(symbol[touched], symbol[after[touched]])
            touched = touched[made[touched] >= 0]
            if len(touched):
                again.update(word[touched[made[touched] < r]].tolist())
                enter(touched)
        alive = symbol >= 0
        size = np.bincount(word[alive], minlength=len(words))
        ids = symbol[alive]
        if again:
            parts, cuts = [], np.concatenate(([0], np.cumsum(size)))
            for i in range(len(words)):
                parts.append(self.one(words[i]) if i in again else ids[cuts[i] : cuts[i + 1]])
            size = np.array([len(p) for p in parts])
            ids = np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else ids
        return ids.astype(np.uint32), np.concatenate(([0], np.cumsum(size)))


_loaded: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    """The rank file, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


#: What \\s stands for in the split pattern: characters with the White_Space property (fixed values).
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """Letter, number, space or other, for every code point."""
    if not _kinds:
        table = np.full(0x110000, _OTHER, np.uint8)
        points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for found in regex.finditer(pattern, points):
                table[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
        table[0xD800:0xE000] = _OTHER
        table[list(SPACES)] = _SPACE
        _kinds.append(table)
    return _kinds[0]


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, value) of the characters of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    value = lead.astype(np.int32)
    for low, high, size, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        total = value[k] & bits
        for j in range(1, size):
            total = total << 6 | data[np.minimum(at[k] + j, len(data) - 1)].astype(np.int32) & 0x3F
        value[k] = np.minimum(total, 0x10FFFF)
    return at, value


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the matches of the public split pattern begin; they leave no byte out.

    The pattern: contractions ('s 't 're 've 'm 'll 'd), then runs of letters, numbers or others with one blank before,
    then white space, of which the last character is left to what follows.
    """
    at, point = _code_points(data)
    kind = _kind_table()[point]
    n = len(at)
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    opens[n] = True
    start = opens[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = start.copy()
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~opens[1:n]) if n else np.zeros(0, np.int64)
    start[last] = True
    start[last + 1] = point[last] != 0x20
    mark = np.flatnonzero((point == 0x27) & start & run)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == _LETTER) & ~opens[mark + 1]]
    if len(mark):
        one = point[mark + 1]
        two = np.where((mark + 2 < n) & ~opens[np.minimum(mark + 2, n)], point[np.minimum(mark + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, size)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        inner = mark[size == 2] + 2
        start[inner] = False
        rest = mark + 1 + size
        start[rest[rest < n]] = True
    return at[start]


class _Dictionary:
    """Pre-tokens of a task by hash, with their ids."""

    def __init__(self):
        self.hash, self.entry = np.zeros(0, tb.U64), np.zeros(0, np.int64)
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.fresh: list[bytes] = []

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each span; unknown ones are added, their ids are there after ``learn``."""
        value, first, inverse = np.unique(tb.SpanHash(data)(start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, value), max(0, len(self.hash) - 1))
        new = self.hash[at] != value if len(self.hash) else np.ones(len(value), bool)
        if new.any():
            whole = memoryview(data)
            self.fresh += [bytes(whole[a:b]) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            hashes = np.concatenate((self.hash, value[new]))
            order = np.argsort(hashes, kind="stable")
            self.entry = np.concatenate((self.entry, np.arange(len(self.hash), len(hashes))))[order]
            self.hash = hashes[order]
        return self.entry[np.searchsorted(self.hash, value)][inverse].astype(np.int32)

    def learn(self, table: Ranks) -> None:
        if self.fresh:
            ids, cuts = table.replay(self.fresh)
            self.begin = np.concatenate((self.begin, cuts[1:] + self.begin[-1]))
            self.ids = np.concatenate((self.ids, ids))
            self.fresh = []


def bpe_encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", remember: int = 400_000) -> DataFrame:
    """(doc_id, n_bytes, ids) of every row; ``ids`` is binary, little-endian unsigned 32-bit, four bytes a token.

    Each match of the public split pattern is encoded separately, without special tokens. Null and empty texts have no
    ids. Rows are encoded one by one, repeated ids included; other columns are not read. No shuffle. A task forgets
    its dictionary beyond ``remember`` pre-tokens; that costs time only. The rank file must exist on the executors.
    """

    def encode(batches):
        table, known = ranks(rank_path), _Dictionary()
        for batch in batches:
            for lo, hi, data, offsets in tb.blocks(batch.column(1), BLOCK_BYTES):
                if len(known.hash) > remember:
                    known = _Dictionary()
                held, row = [], 0
                while row < hi - lo:  # parts of a block, so that hashes need little memory
                    stop = min(hi - lo, max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART_BYTES, "right")) - 1))
                    part, cuts = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
                    start = pre_tokens(part, cuts)
                    held.append((row, stop, known.entries(part, start, np.append(start[1:], len(part))), np.searchsorted(start, cuts)))
                    row = stop
                known.learn(table)
                for row, stop, entry, cuts in held:
                    size = known.begin[entry + 1] - known.begin[entry]
                    ids = known.ids[gather(known.begin[entry], size)].astype("<u4")
                    ends = np.concatenate(([0], np.cumsum(size)))[cuts] * 4
                    out = pa.Array.from_buffers(pa.large_binary(), stop - row, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo + row, stop - row).cast(pa.int64()), pa.array(np.diff(offsets[row : stop + 1])), out.cast(pa.binary())],
                        names=["doc_id", "n_bytes", "ids"])

    return docs.select(id_col, text_col).mapInArrow(tb.trimmed(encode), "doc_id long, n_bytes long, ids binary")


def bpe_decode(tokens: DataFrame, rank_path: str) -> DataFrame:
    """``tokens`` (doc_id, n_bytes, ids) with ``decoded``, the bytes that the ids stand for. No shuffle."""

    def decode(batches):
        table = ranks(rank_path)
        for batch in batches:
            out = []
            for x in batch.column(2):
                ids = np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64)
                out.append(table.bytes[gather(table.begin[ids], table.begin[ids + 1] - table.begin[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "ids", "decoded"])

    return tokens.select("doc_id", "n_bytes", "ids").mapInArrow(tb.trimmed(decode), "doc_id long, n_bytes long, ids binary, decoded binary")

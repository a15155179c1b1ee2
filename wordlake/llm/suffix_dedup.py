"""Operator 8, suffix-array dedup: common-prefix-aware distributed merge sort of sampled suffixes.

Every byte covered by a 100-byte string that also starts earlier (smaller id, or same document and earlier) goes. A
suffix at each byte would be 100 times the text; equal windows choose the same anchor (``anchors``), so the suffixes at
anchors are sorted and each carries the few bytes to its left that its windows need.

1. Anchors whose gram nobody else has can't repeat; blocks by gram hash find the others. A task sends a gram once.
2. Tasks sort the suffixes of the other anchors into runs. What a task's own earlier windows repeat is decided there,
   so a passage that many documents share leaves it once. Runs are cut at common splitters and front-coded: of each
   suffix the length shared with the one before it and the rest.
3. A loser tree merges the runs of a key range. Players carry the prefix they share with the last winner; the longer
   one wins unseen, equal ones are compared behind it, known prefixes never again. The merged order comes with the
   shared length of neighbours, which gives for each window length the suffixes with equal right parts; with equal
   left parts (64-bit hashes) they are equal windows, and all but the earliest are marked.
4. Marks go back to their documents. The documents are exchanged by id for step 2 and again, with the columns to keep, for
   step 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordlake.llm import textblocks as tb
from wordlake.llm.anchors import WINDOW, anchors
from wordlake.llm.lm_scoring import block_count
from wordlake.session import cut_lineage

BLOCK_TEXT = 48 << 20
#: Key ranges of the merge for each block of text; anchors that a task sorts at once.
RANGES, RUN = 4, 150_000
NULL_ID = (1 << 63) - 1
_TAIL = np.zeros(WINDOW, np.uint8)


def _ipc(**columns) -> bytes:
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_ipc(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _taken(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the runs [start, start + size), some at a time."""
    size = size.astype(np.int64)
    step = 20_000
    return np.concatenate([data[:0], *(data[_runs(start[i : i + step], size[i : i + step])] for i in range(0, len(start), step))])


def _prefix(right: np.ndarray) -> np.ndarray:
    """The first 8 bytes of suffixes as unsigned numbers in their order."""
    return np.ascontiguousarray(right[:, :8]).view(">u8").ravel().astype(tb.U64)


def _text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of the texts of a block; of a text longer than a block's bytes, which is a block of its own, piece by piece."""
    if len(data) <= tb.BLOCK_BYTES:
        return tb.SpanHash(data)(offsets[:-1], offsets[1:]).view(np.int64)
    out = np.zeros(len(offsets) - 1, tb.U64)
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for begin in range(lo, max(hi, lo + 1), tb.BLOCK_BYTES):
            part = data[begin : min(hi, begin + tb.BLOCK_BYTES)]
            piece = tb.SpanHash(part)(np.array([0]), np.array([len(part)]))
            out[i : i + 1] = piece if hi - lo <= tb.BLOCK_BYTES else tb.mix(out[i : i + 1] ^ piece)
    return out.view(np.int64)


def repeated_grams(docs: DataFrame, blocks: int) -> DataFrame:
    """From (k, text): rows (k, grams) with 32-bit parts of the gram hashes of k that occur twice or more, and rows
    with only ``prefix``, evenly spaced samples of each task's sorted suffixes. A few grams too many do no harm."""

    def send(batches):
        turn = 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, data, offsets in tb.blocks(batch.column(1)):
                at, _, _, gram = anchors(data, offsets)
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, "right") - 1
                value, first, inverse, count = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
                part = (value >> tb.U64(32)).astype(np.uint32)
                many = count[inverse] > 1
                pair = np.unique(np.stack((row[many], part[inverse[many]].astype(np.int64))), axis=1)
                size = np.bincount(pair[0], minlength=hi - lo)
                held = np.flatnonzero(size)
                sample = np.sort(_prefix(np.concatenate((data, _TAIL))[at[:, None] + np.arange(8)]))[np.linspace(0, len(at) - 1, 64).astype(int)]
                own = _ipc(k=keys[lo:hi][held], grams=_binary(pair[1].astype("<u4").view(np.uint8), size[held] * 4))
                of = (tb.mix(value) % tb.U64(blocks)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(blocks + 1))
                single = np.where(count == 1, row[first], -1)
                out: list[list] = [[], [], [], [], [], []]
                for b in range(blocks):
                    mine, here = b == turn % blocks, order[cuts[b] : cuts[b + 1]]
                    if len(here) or mine:
                        alone = single[here] >= 0
                        rows, index = np.unique(single[here][alone], return_inverse=True)
                        place = np.full(len(here), -1, "<i4")
                        place[alone] = index
                        for o, v in zip(out, (b, keys[lo:hi][rows].tobytes(), place.tobytes(), part[here].tobytes(), own if mine else None, sample.tobytes() if mine else None)):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["block", "keys", "place", "part", "own", "sample"])
                turn += 1

    def find(table: pa.Table) -> pa.Table:
        parts, begin, keys, place, value = [], 0, [], [], []
        for ks, p, v, own, sample in zip(*(table.column(c).to_pylist() for c in ("keys", "place", "part", "own", "sample"))):
            if own:
                got, prefix = _from_ipc(own), (np.frombuffer(sample, tb.U64) ^ tb.U64(1 << 63)).view(np.int64)
                parts.append(pa.Table.from_arrays([got.column(0), got.column(1), pa.nulls(len(got), pa.int64())], names=["k", "grams", "prefix"]))
                parts.append(pa.Table.from_arrays([pa.nulls(len(prefix), pa.int64()), pa.nulls(len(prefix), pa.binary()), pa.array(prefix)], names=["k", "grams", "prefix"]))
            keys.append(np.frombuffer(ks, np.int64))
            at = np.frombuffer(p, "<i4").astype(np.int64)
            place.append(np.where(at >= 0, at + begin, -1))
            value.append(np.frombuffer(v, np.uint32))
            begin += len(keys[-1])
        keys, place, value = np.concatenate(keys), np.concatenate(place), np.concatenate(value)
        _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
        told = np.bincount(inverse, weights=place < 0) > 0 if len(value) else np.zeros(0, bool)
        hit = (place >= 0) & ((count > 1) | told)[inverse]
        order = np.lexsort((value[hit], place[hit]))
        of, value = place[hit][order], value[hit][order]
        rows, size = np.unique(of, return_counts=True)
        parts.append(pa.Table.from_arrays([pa.array(keys[rows]), _binary(value.astype("<u4").view(np.uint8), size * 4), pa.nulls(len(rows), pa.int64())], names=["k", "grams", "prefix"]))
        return pa.concat_tables(parts)

    sent = docs.mapInArrow(tb.trimmed(send), "block int, keys binary, place binary, part binary, own binary, sample binary")
    return sent.groupBy("block").applyInArrow(tb.trimmed_group(find), "k long, grams binary, prefix long")


class Suffixes:
    """Sorted suffixes with the shared length of neighbours, their place (k, text, pos) and their windows.

    Window starts are ``pos - left`` for ``least <= left <= most``; ``before`` holds the ``most`` bytes left of each.
    """

    def __init__(self, lcp, k, text, pos, least, most, before):
        self.lcp, self.k, self.text, self.pos, self.least, self.most, self.before = lcp, k, text, pos, least, most, before

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, left) of the windows that an earlier one, by (k, start), equals."""
        n = len(self.lcp)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.lexsort((self.pos, self.k))
        new = np.concatenate(([True], (np.diff(self.k[order]) != 0) | (np.diff(self.pos[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        end = np.cumsum(self.most.astype(np.int64))
        span = tb.SpanHash(self.before)
        found, lefts = [], []
        for left in range(int(self.least.min()), int(self.most.max()) + 1):
            at = np.flatnonzero((self.least <= left) & (self.most >= left))
            if len(at) < 2:
                continue
            right = np.cumsum(self.lcp < WINDOW - left)[at].astype(tb.U64)
            key = tb.mix(right ^ tb.mix(span(end[at] - left, end[at])))
            order = np.argsort(key)
            begin = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
            first = np.minimum.reduceat(rank[at[order]], begin)
            late = rank[at[order]] > np.repeat(first, np.diff(np.append(begin, len(at))))
            found.append(at[order[late]])
            lefts.append(np.full(len(found[-1]), left))
        return (np.concatenate(found), np.concatenate(lefts)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def marks(self, suffix: np.ndarray, left: np.ndarray) -> pa.Table:
        """(k, marks): for each document the text's hash and the byte spans of the given windows, as 64-bit triples."""
        start = self.pos[suffix] - left
        order = np.lexsort((start, self.text[suffix], self.k[suffix]))
        k, text, start = self.k[suffix][order], self.text[suffix][order], start[order]
        if not len(k):
            return pa.table({"k": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
        other = (np.diff(k) != 0) | (np.diff(text) != 0)
        cut = np.concatenate(([0], np.flatnonzero(other | (np.diff(start) > WINDOW)) + 1, [len(k)]))
        spans = np.stack((text[cut[:-1]], start[cut[:-1]], start[cut[1:] - 1] + WINDOW), 1).astype("<i8")
        ks, size = np.unique(k[cut[:-1]], return_counts=True)
        return pa.table({"k": ks, "marks": _binary(spans.view(np.uint8), size * 24)})


def _extend(a: bytes, b: bytes, h: int) -> int:
    """The shared length of a and b, which share h bytes at least."""
    if a[h:] == b[h:]:
        return len(a)
    while a[h : h + 8] == b[h : h + 8]:
        h += 8
    while a[h] == b[h]:
        h += 1
    return h


def merge_runs(runs: Sequence[tuple[Sequence[int], Sequence[bytes]]]) -> tuple[list[int], list[int], list[int]]:
    """(run, index in the run, length shared with the one before) of all suffixes in order.

    A run is front-coded: (shared with the one before, rest); all suffixes are ``WINDOW`` bytes long.
    """
    size = 1
    while size < len(runs):
        size *= 2
    key: list[bytes] = [b""] * size
    share, at, ends = [-1] * size, [0] * size, [0] * size  # share: with the last winner; -1: the run is over
    for r, (_, rest) in enumerate(runs):
        ends[r] = len(rest)
        if rest:
            key[r], share[r] = rest[0], 0
    loser = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        if share[x] != share[y]:
            return (x, y) if share[x] > share[y] else (y, x)
        if share[x] < 0:
            return x, y
        a, b = key[x], key[y]
        h = _extend(a, b, share[x])
        if h == len(a) or a[h] < b[h]:
            share[y] = h
            return x, y
        share[x] = h
        return y, x

    def build(node: int) -> int:
        if node >= size:
            return node - size
        x, loser[node] = play(build(2 * node), build(2 * node + 1))
        return x

    out_run, out_at, out_share = [], [], []
    x = build(1)
    while share[x] >= 0:
        lcps, rests = runs[x]
        i, h = at[x], share[x]
        while True:
            out_run.append(x)
            out_at.append(i)
            out_share.append(h)
            i += 1
            if i == ends[x]:
                share[x] = -1
                break
            h = lcps[i]
            if h < WINDOW:
                key[x], share[x] = key[x][:h] + rests[i], h
                break
        at[x] = i
        node = (x + size) >> 1
        while node:
            y = loser[node]
            x, loser[node] = play(x, y)
            node >>= 1
    return out_run, out_at, out_share


def _sorted_run(parts: list[tuple], splitters: np.ndarray, turn: int):
    """Rows (range, run, own): the run of the given suffixes, what their own windows repeat already marked in ``own``."""
    right, k, text, pos, least, most, before = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(np.ascontiguousarray(right).view(f"S{WINDOW}").ravel(), kind="stable")
    right, k, text, pos, least = right[order], k[order], text[order], pos[order], least[order]
    begin = np.cumsum(most.astype(np.int64)) - most
    before, most = _taken(before, begin[order], most[order]), most[order]

    def shared(r: np.ndarray) -> np.ndarray:
        differ = r[1:] != r[:-1]
        return np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), WINDOW))).astype(np.int64)

    s = Suffixes(shared(right), k, text, pos, least, most, before)
    suffix, left = s.repeats()
    own = s.marks(suffix, left)
    keep = np.flatnonzero(np.bincount(suffix, minlength=len(k)) < most.astype(np.int64) - least + 1)
    right = right[keep]
    begin = np.cumsum(most.astype(np.int64)) - most
    of = np.searchsorted(splitters, _prefix(right), "right")
    lcp = shared(right) if len(right) else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(1, np.int64)
    out: list[list] = [[], [], []]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at, n = keep[a:b], lcp[a:b].copy()
        n[0] = 0
        rest = right[a:b][np.arange(WINDOW) >= n[:, None]]
        sizes = most[at].astype(np.int64)
        out[0].append(int(of[a]))
        out[1].append(_ipc(lcp=n.astype(np.uint8), rest=_binary(rest, WINDOW - n), k=k[at], text=text[at], pos=pos[at].astype(np.int32), least=least[at], most=most[at],
                           before=_binary(_taken(before, begin[at], sizes), sizes)))
        out[2].append(None)
    if own.num_rows:
        out[0].append(turn % (len(splitters) + 1))
        out[1].append(None)
        out[2].append(_ipc(k=own.column(0).combine_chunks(), marks=own.column(1).combine_chunks()))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["range", "run", "own"])


def marked_spans(docs: DataFrame, splitters: np.ndarray) -> DataFrame:
    """(k, marks) from (k, text, grams): the repeated windows of all documents, decided by the merge."""

    def sort(batches):
        parts, held, turn = [], 0, 0
        for batch in batches:
            keys, grams = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi, data, offsets in tb.blocks(batch.column(1)):
                lists = [[np.frombuffer(g, "<u4") for g in x] if x else [] for x in grams.slice(lo, hi - lo).to_pylist()]
                wanted = [tb.with_row(np.full(len(g), i), g.astype(tb.U64)) for i, gs in enumerate(lists) for g in gs]
                if not wanted:
                    continue
                wanted = np.unique(np.concatenate(wanted))
                at, first, last, gram = anchors(data, offsets)
                row = np.searchsorted(offsets, at, "right") - 1
                mine = tb.with_row(row, gram >> tb.U64(32))
                hit = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
                at, first, last, row = at[hit], first[hit], last[hit], row[hit]
                texts = _text_hashes(data, offsets)
                padded = np.concatenate((data, _TAIL))
                for a in range(0, len(at), RUN):
                    p, f, r = at[a : a + RUN], first[a : a + RUN], row[a : a + RUN]
                    # no window reaches further than to the end of the last one; zeros behind it change no comparison
                    right = _taken(padded, p, np.full(len(p), WINDOW)).reshape(-1, WINDOW)
                    right[np.arange(WINDOW, dtype=np.uint8) >= (last[a : a + RUN] + WINDOW - p).astype(np.uint8)[:, None]] = 0
                    parts.append((right, keys[lo:hi][r], texts[r], p - offsets[r], (p - last[a : a + RUN]).astype(np.uint8), (p - f).astype(np.uint8), _taken(data, f, p - f)))
                    held += len(p)
                    if held >= RUN:
                        yield _sorted_run(parts, splitters, turn)
                        parts, held, turn = [], 0, turn + 1
        if held:
            yield _sorted_run(parts, splitters, turn)

    def merge(table: pa.Table) -> pa.Table:
        out = [_from_ipc(x) for x in table.column("own").to_pylist() if x]
        out = [pa.Table.from_batches([b]) for b in out]
        runs = [_from_ipc(x) for x in table.column("run").to_pylist() if x]
        if runs:
            run, index, share = merge_runs([(r.column("lcp").to_pylist(), r.column("rest").to_pylist()) for r in runs])
            begin = np.cumsum([0, *(len(r) for r in runs)])
            order = begin[np.array(run)] + np.array(index)
            whole = pa.Table.from_batches([r.select(["k", "text", "pos", "least", "most", "before"]) for r in runs]).combine_chunks()
            whole = whole.take(pa.array(order))
            col = lambda c: whole.column(c).to_numpy()
            before = np.frombuffer(b"".join(x for x in whole.column("before").to_pylist()), np.uint8)
            s = Suffixes(np.array(share), col("k"), col("text"), col("pos").astype(np.int64), col("least"), col("most"), before)
            out.append(s.marks(*s.repeats()))
        schema = pa.schema([("k", pa.int64()), ("marks", pa.binary())])
        return pa.concat_tables([x.cast(schema) for x in out]) if out else schema.empty_table()

    return docs.mapInArrow(tb.trimmed(sort), "range int, run binary, own binary").groupBy("range").applyInArrow(tb.trimmed_group(merge), "k long, marks binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans and kept_sha256; ``kept_text`` if asked for.

    Null texts count as empty ones, texts under 100 bytes have no windows. Rows with equal ids are one document: the
    same start in two of them is neither earlier. Null ids come after all others and are one document. Columns named
    in ``keep`` pass through as ``in_<name>``; others are not read. Spans may cut characters; in ``kept_text`` the
    bytes that are left of such a character are dropped, the digest covers them. Windows are compared by the sorted
    order of their right part and a 64-bit hash of their left part. A text may be as long as a Spark string.
    """
    blocks = block_count(docs, text_col, BLOCK_TEXT)
    picked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"),
                         *(F.col(c).alias(f"in_{c}") for c in keep))
    with tb.small_batches(docs.sparkSession):
        grams = cut_lineage(repeated_grams(picked.select("k", "text"), blocks))
    fractions = [i / (blocks * RANGES) for i in range(1, blocks * RANGES)]
    cuts = grams.where("prefix is not null").agg(F.percentile_approx("prefix", fractions, 10_000).alias("p")).first().p or []
    splitters = np.unique((np.array(cuts, np.int64).view(tb.U64) ^ tb.U64(1 << 63)))
    by_id = picked.repartition(max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "k")
    wanted = grams.where("k is not null").groupBy("k").agg(F.collect_list("grams").alias("grams"))
    marks = marked_spans(by_id.join(wanted, "k", "left").select("k", "text", "grams"), splitters)
    marks = marks.groupBy("k").agg(F.collect_list("marks").alias("marks"))
    source = by_id.join(marks, "k", "left")
    fields = T.StructType([*T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string").fields,
                           *(f for f in source.schema.fields if f.name.startswith("in_"))])
    passed = [f.name for f in fields if f.name.startswith("in_")]

    def cut(batches):
        for batch in batches:
            for lo, hi, data, offsets in tb.blocks(batch.column("text")):
                texts = _text_hashes(data, offsets)
                out: list[list] = [[], [], [], [], []]
                for i, found in enumerate(batch.column("marks").slice(lo, hi - lo).to_pylist()):
                    raw = data[offsets[i] : offsets[i + 1]]
                    gone = np.zeros(len(raw) + 1, np.int32)
                    for m in found or ():
                        spans = np.frombuffer(m, "<i8").reshape(-1, 3)
                        spans = spans[spans[:, 0] == texts[i]]
                        np.add.at(gone, spans[:, 1], 1)
                        np.add.at(gone, spans[:, 2], -1)
                    gone = np.cumsum(gone[:-1], out=gone[:-1]) > 0
                    left = raw[~gone].tobytes()
                    edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) > 0 and bool(gone[0]))
                    for o, v in zip(out, (len(raw), int(gone.sum()), edges, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if with_text else None)):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))),
                                                  *(batch.column(c).slice(lo, hi - lo) for c in passed)], names=fields.names)

    found = source.mapInArrow(tb.trimmed(cut), fields)
    return found if with_text else found.drop("kept_text")

"""Windows over streams longer than a row (J9, C1-C5, W9): a whole corpus read as one sequence of tokens.

A stream is cut into segments, rows of at most some thousand consecutive tokens: a document is one already, and rows
of (stream, order, token) are packed by one range sort (`pack`). What lies inside a segment comes from array
expressions, without a join. Only what crosses a segment's border needs the neighbours, and for that the first and last
``window`` tokens of each segment are exchanged (`borders`): a table of a few tokens a segment is numbered by a range
sort and cut into buckets that share ``window`` segments with the next, so no group holds a stream and no stream's array
is ever built. Segments may be shorter than the window; it then reaches over as many as it needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordlake.operators import cooccur as co
from wordlake.operators.ordering import global_index
from wordlake.session import cut_lineage

SEGMENT = 4096
BUCKET = 1024
PAD = "--"


def pack(tokens: DataFrame, order_cols: list[str], token_col: str = "token", stream_col: str | None = None, size: int = SEGMENT) -> DataFrame:
    """Segments (stream, at, tokens, keys) of token rows: ``at`` orders the segments, ``keys`` holds the order columns of
    each token. ``order_cols`` give a total order within a stream; no ``stream_col`` means one stream. Null tokens are
    left out. One range sort; the segments are written, as its borders would not be the same twice."""
    rows = tokens.where(F.col(token_col).isNotNull()).select(
        F.col(stream_col).alias("stream") if stream_col else F.lit(0).alias("stream"), F.struct(*order_cols).alias("key"), F.col(token_col).alias("token"))
    rows = rows.repartitionByRange("stream", "key").sortWithinPartitions("stream", "key")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def segments(batches):
        part, seg = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            stream = batch.column("stream")
            code = stream.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.union1d(np.flatnonzero(code[1:] != code[:-1]) + 1, np.arange(0, n, size))
            offsets = pa.array(np.append(cuts, n).astype(np.int32))
            at = pa.StructArray.from_arrays([pa.array(np.full(len(cuts), part, np.int32)), pa.array(np.arange(seg, seg + len(cuts)))], names=["part", "seg"])
            seg += len(cuts)
            yield pa.RecordBatch.from_arrays(
                [stream.take(pa.array(cuts)), at, pa.ListArray.from_arrays(offsets, batch.column("token")), pa.ListArray.from_arrays(offsets, batch.column("key"))],
                names=["stream", "at", "tokens", "keys"])

    return cut_lineage(rows.mapInArrow(segments, f"stream {kind['stream']}, at struct<part:int,seg:long>, tokens array<{kind['token']}>, keys array<{kind['key']}>"))


def segments_of(rows: DataFrame, arr_col: str, order_cols: list[str], stream_col: str | None = None) -> DataFrame:
    """Segments (stream, at, tokens) of rows that hold an array of tokens each, in the order of ``order_cols`` (unique in
    a stream). Rows without tokens are left out: windows reach over them."""
    return rows.where(F.size(arr_col) > 0).select(
        F.col(stream_col).alias("stream") if stream_col else F.lit(0).alias("stream"), F.struct(*order_cols).alias("at"), F.col(arr_col).alias("tokens"))


def _last(arr: Column, n: int) -> Column:
    """The last ``n`` elements."""
    return F.slice(arr, F.greatest(F.size(arr) - n, F.lit(0)) + 1, n)


def borders(segments: DataFrame, window: int) -> DataFrame:
    """(stream, at, n, head, tail, before, after) of every segment: its size, its first and last ``window`` tokens, and
    the ``window`` tokens before and after it in its stream (fewer at the stream's ends), all in the stream's order."""
    ends = segments.select("stream", "at", F.size("tokens").alias("n"), F.slice("tokens", 1, window).alias("head"), _last(F.col("tokens"), window).alias("tail"))
    numbered = global_index(ends, [F.asc("stream"), F.asc("at")], "number")
    place = F.col("number") % BUCKET
    own = F.floor(F.col("number") / BUCKET)
    # a segment also stands in the next bucket if it is among the last of its own, and in the one before if among the first
    more = F.array_compact(F.array(own, F.when(place >= BUCKET - window, own + 1), F.when(place < window, own - 1)))
    near = numbered.withColumn("own", own).withColumn("bucket", F.explode(more))
    w = Window.partitionBy("bucket").orderBy("number")

    def joined(col: str, lo: int, hi: int) -> Column:
        others = F.collect_list(F.struct("stream", F.col(col).alias("t"))).over(w.rowsBetween(lo, hi))
        return F.flatten(F.transform(F.filter(others, lambda x: x["stream"].eqNullSafe(F.col("stream"))), lambda x: x["t"]))

    near = near.withColumns({"before": joined("tail", -window, -1), "after": joined("head", 1, window)}).where(F.col("bucket") == F.col("own"))
    return near.select("stream", "at", "n", "head", "tail", _last(F.col("before"), window).alias("before"), F.slice("after", 1, window).alias("after"))


def _numbered(arr: str) -> Column:
    """(i, x) of every element of an array, i from 0."""
    return F.transform(arr, lambda x, i: F.named_struct(F.lit("i"), i, F.lit("x"), x))


def _crossing(edges: DataFrame) -> DataFrame:
    """(p, q, b, h, col, row): tokens p (of ``before``) and q > p of ``before`` then ``head``, b and h tokens long; q may
    also lie in ``before``."""
    e = edges.where(F.size("before") > 0).select(F.size("before").alias("b"), F.size("head").alias("h"), _numbered("before").alias("left"), F.concat("before", "head").alias("both"))
    e = e.select("b", "h", F.explode("left").alias("l"), _numbered("both").alias("both"))
    return e.select("b", "h", "l", F.explode("both").alias("r")).where(F.col("r.i") > F.col("l.i")).select(
        F.col("l.i").alias("p"), F.col("r.i").alias("q"), "b", "h", F.col("l.x").alias("col"), F.col("r.x").alias("row"))


def context_pairs(segments: DataFrame, window: int, unordered: bool = False) -> DataFrame:
    """(row, col, w): every two tokens p < q of a stream with q - p <= ``window`` (row is the later one) in partial sums,
    w is their number. ``unordered``: the order within a pair doesn't matter, so that it is summed both ways at once."""
    return co.pairs(segments, "tokens", window, unordered=unordered).unionByName(crossing_pairs(segments, window))


def crossing_pairs(segments: DataFrame, window: int) -> DataFrame:
    """Those of `context_pairs` that cross a segment's border."""
    over = _crossing(borders(segments, window)).where((F.col("q") >= F.col("b")) & (F.col("q") - F.col("p") <= window))
    return over.select("row", "col", F.lit(1.0).alias("w"))


def sliding_pairs(segments: DataFrame, window: int, unordered: bool = False) -> DataFrame:
    """(row, col, w) of C4: w counts the tokens t of the stream with q < t <= p + ``window``.

    A count belongs to the segment of t. Inside it the closed form holds with the segment's end as the stream's end;
    counts whose p lies before the segment come from its border."""
    if window < 2:  # never holds two words before the next
        return context_pairs(segments, 1).limit(0)
    inside = co.pairs(segments, "tokens", window - 1, window, unordered=unordered)
    t_first, t_last = F.greatest(F.col("q") + 1, F.col("b")), F.least(F.col("p") + window, F.col("b") + F.col("h") - 1)
    over = _crossing(borders(segments, window)).select("row", "col", (t_last - t_first + 1).cast("double").alias("w")).where("w > 0")
    return inside.unionByName(over)


def matrix(pairs: DataFrame, skip_equal: bool, symmetric: bool) -> DataFrame:
    """(row_word, col_word, weight) sums of pairs: C1 one-sided, C2 / C3 with the transpose added."""
    return co.pair_sums(pairs, skip_equal, symmetric)


def skipgram_rows(segments: DataFrame, window: int, pad: str = PAD, keyed: bool = False) -> DataFrame:
    """W9 over whole streams: (stream, at, i, offset, word, context) for offsets -window..-1 and 1..window of the i-th
    token of a segment; ``pad`` outside the stream. With packed segments, ``keys[i]`` of the segment names the token;
    ``keyed`` rows have it as ``key``, and only those at a segment's borders are joined with it."""
    offsets = [o for o in range(-window, window + 1) if o]
    n = F.size("tokens")
    inside = []
    for o in offsets:  # i from max(0, -o); as many as have a partner inside
        first, m = max(0, -o), F.greatest(n - abs(o), F.lit(0))
        inside.append(F.arrays_zip(F.slice("tokens", first + 1, m).alias("word"), F.slice("tokens", first + o + 1, m).alias("context"),
                                   F.sequence(F.lit(first), F.greatest(m, F.lit(1)) + first - 1).alias("i"), F.array_repeat(F.lit(o), F.greatest(m, F.lit(1))).alias("offset"),
                                   *([F.slice("keys", first + 1, m).alias("key")] if keyed else [])))
    inner = segments.select("stream", "at", F.explode(F.concat(*inside)).alias("x")).where(F.col("x.word").isNotNull()).select(
        "stream", "at", "x.i", "x.offset", "x.word", "x.context", *(["x.key"] if keyed else []))
    edges = borders(segments, window)
    out = []
    for o in offsets:
        if o < 0:  # the i-th token of the head, i < -o: its context is the (-o - i)-th from the end of ``before``
            at = F.size("before") + F.col("y.i") + o
            some = edges.select("stream", "at", "before", F.explode(_numbered("head")).alias("y")).where(F.col("y.i") < -o)
            out.append(some.select("stream", "at", F.col("y.i").alias("i"), F.lit(o).alias("offset"), F.col("y.x").alias("word"),
                                   F.when(at >= 0, F.get("before", F.greatest(at, F.lit(0)))).otherwise(F.lit(pad)).alias("context")))
        else:  # the i-th token of the tail, at most o - 1 before its end
            left = F.col("m") - 1 - F.col("y.i")
            some = edges.select("stream", "at", "n", "after", F.size("tail").alias("m"), F.explode(_numbered("tail")).alias("y")).where(left < o)
            out.append(some.select("stream", "at", (F.col("n") - F.col("m") + F.col("y.i")).alias("i"), F.lit(o).alias("offset"), F.col("y.x").alias("word"),
                                   F.coalesce(F.get("after", F.lit(o - 1) - left), F.lit(pad)).alias("context")))
    outer = out[0]
    for rows in out[1:]:
        outer = outer.unionByName(rows)
    if keyed:
        names = segments.select("stream", "at", n.alias("n"), F.posexplode("keys").alias("i", "key")).where((F.col("i") < window) | (F.col("i") >= F.col("n") - window))
        names = names.select(F.col("stream").alias("__stream"), F.col("at").alias("__at"), F.col("i").alias("__i"), "key")
        outer = outer.join(names, F.col("stream").eqNullSafe(F.col("__stream")) & (F.col("at") == F.col("__at")) & (F.col("i") == F.col("__i"))).drop("__stream", "__at", "__i")
    return inner.unionByName(outer)

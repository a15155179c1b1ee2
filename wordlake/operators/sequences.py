"""Positional window operators.

A "stream" is one row's array (one document by default; the reference lets
windows cross sentence borders, which maps to choosing a coarser row).
Every window/pair is generated inside one array expression and exploded
once: no self-join, no shuffle, and the stream array is never copied into
each output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.operators.ordering import global_index

PAD = "--"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ngrams(arr, n: int) -> Column:
    """All contiguous windows of size n (len-n+1 of them, none if shorter).
    Guarded: ``sequence(1, 0)`` would count down and ``slice`` would raise."""
    a = _c(arr)
    m = F.size(a) - n + 1
    return F.when(m >= 1, F.transform(F.sequence(F.lit(1), m), lambda i: F.slice(a, i, n))) \
        .otherwise(F.array().cast("array<array<string>>"))


def window_rows(df: DataFrame, arr_col: str, n: int, keys) -> DataFrame:
    """W1 as rows: (keys..., start, window)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys, F.posexplode(ngrams(arr_col, n)).alias("start", "window"))


def context_target(window) -> tuple[Column, Column]:
    """context = all but the last element, target = the last."""
    w = _c(window)
    return F.slice(w, 1, F.size(w) - 1), F.element_at(w, -1)


def bigram_strings(arr, sep: str = "_") -> Column:
    """W5: 'a_b' strings of consecutive tokens."""
    return F.transform(ngrams(arr, 2), lambda g: F.array_join(g, sep))


def _pairs_at_offsets(arr, offsets, pad=PAD, keep=None) -> Column:
    """For every position i and offset o: struct(pos, offset, word, context),
    context = arr[i+o] or ``pad`` outside the stream."""
    a = _c(arr)
    n = F.size(a)
    offs = F.array(*[F.lit(o) for o in offsets])

    def at(i, o):
        j = i + o
        ctx = F.when((j >= 1) & (j <= n), F.element_at(a, j)).otherwise(F.lit(pad))
        return F.struct((i - 1).alias("pos"), o.alias("offset"), F.element_at(a, i).alias("word"),
                        ctx.alias("context"))

    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(offs, lambda o: at(i, o))))
    pairs = F.when(n >= 1, pairs)
    if keep is not None:
        pairs = F.filter(pairs, keep)
    return pairs


def skipgram_pairs(df: DataFrame, arr_col: str, window: int, keys, pad: str = PAD) -> DataFrame:
    """(word, context) for the previous ``window`` tokens (forward pass,
    offsets -w..-1) and the next ``window`` (backward pass, 1..w); pads
    outside the stream, equal words kept."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    offsets = list(range(-window, 0)) + list(range(1, window + 1))
    return df.select(*keys, F.explode(_pairs_at_offsets(arr_col, offsets, pad)).alias("p")) \
        .select(*keys, "p.pos", "p.offset", "p.word", "p.context")


def phrase_context_pairs(df: DataFrame, arr_col: str, window: int, length: int, keys,
                         pad: str = PAD) -> DataFrame:
    """At arrival of token t (0-based): target = t-w-L+1..t-w, right
    contexts t-w+1..t, left contexts the w before the target; pads for
    negative positions. One output row per (t, context)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    a = F.col(arr_col)
    n = F.size(a)

    def tok(j):  # 0-based position j
        return F.when(j >= 0, F.element_at(a, j + 1)).otherwise(F.lit(pad))

    def at(t):
        target = F.transform(F.sequence(t - window - length + 1, t - window), lambda j: tok(j))
        ctx_pos = F.concat(F.sequence(t - window - length - window + 1, t - window - length),
                           F.sequence(t - window + 1, t))
        return F.transform(ctx_pos, lambda j, k: F.struct(
            t.alias("t"), F.array_join(target, " ").alias("target"),
            (k - window).alias("slot"), tok(j).alias("context")))

    rows = F.when(n >= 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))
    return df.select(*keys, F.explode(rows).alias("p")).select(*keys, "p.t", "p.target", "p.slot", "p.context")


def sentence_context_pairs(sents: DataFrame, doc_col: str, sent_col: str, text_col: str, window: int,
                           pad: str = PAD) -> DataFrame:
    """Each sentence with each of the previous ``window`` sentences
    (forward) and the next ``window`` (backward); pads outside the document.

    Per-document sentence arrays are small relative to documents, so the
    pairs are generated in one array expression after grouping by document.
    """
    per_doc = sents.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct(sent_col, text_col))).alias("s"))
    arr = F.col("s." + text_col)
    offsets = list(range(-window, 0)) + list(range(1, window + 1))
    p = per_doc.select(doc_col, F.explode(_pairs_at_offsets(arr, offsets, pad)).alias("p"))
    return p.select(doc_col, F.col("p.pos").alias(sent_col), "p.offset",
                    F.col("p.word").alias("sentence"), F.col("p.context").alias("context"))


def sentence_word_pairs(df: DataFrame, sents_col: str, window: int, keys, pad: str = PAD) -> DataFrame:
    """Each sentence (array of words) with each of the ``window`` words
    just before its first word (forward) and just after its last (backward),
    pads outside the document; the true sentence length is kept."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    # materialize the flattened words, their count and the sentence starts
    # once per row: lambda bodies are evaluated per element. A mark before the
    # words of each sentence stands at its start plus the marks before it.
    df = df.select(*keys, F.col(sents_col).alias("__s"), F.flatten(sents_col).alias("__words"), F.flatten(F.transform(
        sents_col, lambda x: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), F.size(x))))).alias("__marks"))
    marked = F.filter(F.transform("__marks", lambda m, p: F.when(m, p)), lambda p: p.isNotNull())
    df = df.select(*keys, "__s", "__words", F.size("__words").alias("__n"), F.transform(marked, lambda p, k: p - k).alias("__start"))
    s, words, n = F.col("__s"), F.col("__words"), F.col("__n")

    def at(sent, k):
        start = F.element_at("__start", k + 1)  # 0-based first word of the sentence
        end = start + F.size(sent) - 1

        def ctx(j):
            return F.when((j >= 0) & (j < n), F.element_at(words, j + 1)).otherwise(F.lit(pad))
        before = F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.struct(
            k.alias("sent_id"), (-d).alias("offset"), F.array_join(sent, " ").alias("sentence"),
            F.size(sent).alias("length"), ctx(start - d).alias("context")))
        after = F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.struct(
            k.alias("sent_id"), d.alias("offset"), F.array_join(sent, " ").alias("sentence"),
            F.size(sent).alias("length"), ctx(end + d).alias("context")))
        return F.concat(before, after)

    rows = F.flatten(F.transform(s, at))
    return df.select(*keys, F.explode(rows).alias("p")).select(
        *keys, "p.sent_id", "p.offset", "p.sentence", "p.length", "p.context")


def batches(df: DataFrame, order_cols, batch_size: int, drop_last: bool = True) -> DataFrame:
    """Fixed-size batches in an explicit order; the incomplete last
    batch is dropped (or kept). Batch ids come from the scalable global index."""
    idx = global_index(df, order_cols, "__row")
    out = idx.withColumn("batch_id", F.floor(F.col("__row") / batch_size).cast("long")) \
        .withColumn("batch_pos", (F.col("__row") % batch_size).cast("int"))
    if drop_last:
        total = df.agg(F.count(F.lit(1)).alias("__n"))
        full = total.select((F.floor(F.col("__n") / batch_size) * batch_size).alias("__full"))
        out = out.crossJoin(F.broadcast(full)).where(F.col("__row") < F.col("__full")).drop("__full")
    return out.drop("__row")


def pad_batches(batched: DataFrame, ids_col: str, pad_value) -> DataFrame:
    """V8: pad each sequence on the right to its batch's longest, with mask
    and true length. The batch max is a grouped aggregate joined back
    (batches are bounded by batch_size rows)."""
    mx = batched.groupBy("batch_id").agg(F.max(F.size(ids_col)).alias("__max"))
    j = batched.join(mx, "batch_id")
    return j.select("*", F.size(ids_col).alias("length"),
                    ar.pad_right(ids_col, F.col("__max"), pad_value).alias("padded"),
                    ar.mask(ids_col, F.col("__max")).alias("mask")).drop("__max")


def length_buckets(df: DataFrame, arr_col: str) -> DataFrame:
    """Group texts by token count (bucket = length)."""
    return df.withColumn("length", F.size(arr_col))


def encoder_features(ids, max_len: int, cls_id: int, sep_id: int, pad_id: int = 0) -> Column:
    """V14 (single text): [CLS] ids[:L-2] [SEP], mask, segment ids, zero pad to L.
    Returns a struct(input_ids, input_mask, segment_ids)."""
    a = _c(ids).cast("array<long>")
    body = F.slice(a, 1, max_len - 2)
    seq = F.concat(F.array(F.lit(cls_id).cast("long")), body, F.array(F.lit(sep_id).cast("long")))
    n = F.size(seq)
    pad = F.greatest(F.lit(max_len) - n, F.lit(0))
    input_ids = F.concat(seq, F.array_repeat(F.lit(pad_id).cast("long"), pad))
    input_mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad))
    segment_ids = F.array_repeat(F.lit(0), F.lit(max_len))
    return F.struct(input_ids.alias("input_ids"), input_mask.alias("input_mask"),
                    segment_ids.alias("segment_ids"))


def encoder_pair_features(ids_a, ids_b, max_len: int, cls_id: int, sep_id: int, pad_id: int = 0) -> Column:
    """V14 (pair) with V15 truncation to L-3: [CLS] a [SEP] b [SEP]; segment
    ids 0 for the first part (incl. CLS and first SEP), 1 for the second."""
    a, b = _c(ids_a).cast("array<long>"), _c(ids_b).cast("array<long>")
    la, lb = ar.truncate_pair_lengths(F.size(a), F.size(b), max_len - 3)
    a2, b2 = F.slice(a, 1, la), F.slice(b, 1, lb)
    cls, sep = F.array(F.lit(cls_id).cast("long")), F.array(F.lit(sep_id).cast("long"))
    seq = F.concat(cls, a2, sep, b2, sep)
    n = F.size(seq)
    pad = F.greatest(F.lit(max_len) - n, F.lit(0))
    seg = F.concat(F.array_repeat(F.lit(0), la + 2), F.array_repeat(F.lit(1), lb + 1), F.array_repeat(F.lit(0), pad))
    return F.struct(F.concat(seq, F.array_repeat(F.lit(pad_id).cast("long"), pad)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad)).alias("input_mask"),
                    seg.alias("segment_ids"))

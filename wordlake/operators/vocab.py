"""Vocabulary and encoding jobs (A3, W7, W8, V1-V6, V11-V13, T7, E2 index).

A vocabulary is a DataFrame ``(symbol, idx, freq)``. Frequencies come from a
grouped count with map-side partial aggregation, so a hot token (a third of
all rows) costs one row per map partition in the shuffle. Indices come from
`global_index`, never from an unpartitioned window over the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.operators import blocks as bl
from wordlake.operators.ordering import global_index
from wordlake.session import cut_lineage

SPECIALS = ("<UNK>", "<PAD>", "<GO>")


def token_table(df: DataFrame, tokens_col: str, keys, token_name: str = "token",
                pos_name: str = "pos") -> DataFrame:
    """Array column -> one row per (keys..., pos, token); narrow, no shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys, F.posexplode(tokens_col).alias(pos_name, token_name))


def frequencies(tokens: DataFrame, token_col: str = "token", name: str = "symbol") -> DataFrame:
    """A3: symbol -> count (long)."""
    return tokens.groupBy(F.col(token_col).alias(name)).agg(F.count(F.lit(1)).alias("freq"))


def frequency_vocabulary(tokens: DataFrame, token_col: str = "token", start: int = 0) -> DataFrame:
    """Idx by (freq desc, symbol desc) -> (symbol, freq, idx)."""
    freq = frequencies(tokens, token_col)
    return global_index(freq, [F.desc("freq"), F.desc("symbol")], "idx", start)


def with_specials(vocab: DataFrame, specials=SPECIALS) -> DataFrame:
    """V2 / V4: append <UNK>, <PAD>, <GO> after the last index, in that order."""
    spark = vocab.sparkSession
    base = vocab.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).cast("long").alias("base"))
    lit_rows = spark.createDataFrame([(s, i) for i, s in enumerate(specials)], "symbol string, k long")
    extra = lit_rows.crossJoin(F.broadcast(base)).select(
        "symbol", F.lit(0).cast("long").alias("freq"), (F.col("base") + F.col("k")).alias("idx"))
    return vocab.select("symbol", "freq", "idx").unionByName(extra)


def first_appearance_index(tokens: DataFrame, order_cols, token_col: str = "token",
                           start: int = 0) -> DataFrame:
    """Index by first appearance in a total order of the stream.

    ``order_cols`` are the stream position columns (e.g. doc_id, pos).
    """
    first = tokens.groupBy(F.col(token_col).alias("symbol")).agg(
        F.min(F.struct(*order_cols)).alias("__first"), F.count(F.lit(1)).alias("freq"))
    out = global_index(first, [F.col("__first")], "idx", start)
    return out.drop("__first")


def capped_vocabulary(tokens: DataFrame, n_words: int, token_col: str = "token") -> DataFrame:
    """V3: idx 0 = UNK (freq = tokens outside), then the n-1 most common.

    Ties in frequency are broken by the symbol (desc) for determinism.
    """
    freq = cut_lineage(frequencies(tokens, token_col))  # the corpus is read once
    top = freq.orderBy(F.desc("freq"), F.desc("symbol")).limit(max(n_words - 1, 0))
    ranked = global_index(top, [F.desc("freq"), F.desc("symbol")], "idx", 1)
    total = freq.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n"))
    kept = ranked.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("k"))
    unk = total.crossJoin(kept).select(F.lit("<UNK>").alias("symbol"),
                                       (F.col("n") - F.col("k")).alias("freq"), F.lit(0).cast("long").alias("idx"))
    return ranked.select("symbol", "freq", "idx").unionByName(unk)


def encode(tokens: DataFrame, vocab: DataFrame, token_col: str = "token",
           unk_idx: int | None = 0, out: str = "idx") -> DataFrame:
    """Token -> index via an equi-join (AQE broadcasts a small vocab).

    ``unk_idx=None`` drops unknown tokens (T7 semantics).
    """
    v = vocab.select(F.col("symbol").alias("__sym"), F.col("idx").alias("__idx"))
    how = "inner" if unk_idx is None else "left"
    j = tokens.join(v, tokens[token_col] == v["__sym"], how)
    idx = F.col("__idx") if unk_idx is None else F.coalesce(F.col("__idx"), F.lit(unk_idx).cast("long"))
    return j.withColumn(out, idx.cast("long")).drop("__sym", "__idx")


def decode(ids: DataFrame, vocab: DataFrame, idx_col: str = "idx", unk: str = "<UNK>",
           out: str = "symbol") -> DataFrame:
    """V6: index -> symbol; unknown indices (and 0 in a compact index) -> <UNK>."""
    v = vocab.select(F.col("idx").alias("__i"), F.col("symbol").alias("__s"))
    j = ids.join(v, ids[idx_col] == v["__i"], "left")
    return j.withColumn(out, F.coalesce(F.col("__s"), F.lit(unk))).drop("__i", "__s")


def collect_sequence(rows: DataFrame, keys, pos_col: str, value_col: str, out: str) -> DataFrame:
    """Re-assemble per-key arrays ordered by position (bounded by one document)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    agg = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos_col, value_col))).alias("__s"))
    return agg.select(*keys, F.col("__s." + value_col).alias(out))


def document_frequency(tokens: DataFrame, doc_col: str, token_col: str = "token") -> DataFrame:
    """Number of distinct documents per term (for min_df)."""
    return tokens.select(doc_col, token_col).distinct().groupBy(F.col(token_col).alias("symbol")) \
        .agg(F.count(F.lit(1)).alias("df"))


def term_counts(docs: DataFrame, arr_col: str, doc_col: str) -> DataFrame:
    """(doc, term, tf), written once. A row's terms are counted where it lies; only documents of several rows are summed."""
    kind = docs.schema[arr_col].dataType.elementType.simpleString()

    def counted(batches):
        for batch in batches:
            doc, arrays = batch.columns
            length = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy().astype(np.int64)
            values = arrays.flatten()
            for lo, hi, start, stop in bl.cuts(length, bl.BLOCK):
                words = values.slice(start, stop - start).dictionary_encode()
                code = pc.fill_null(words.indices, -1).to_numpy().astype(np.int64)
                place = np.repeat(np.arange(lo, hi), length[lo:hi]) * len(words.dictionary) + code
                place, n = np.unique(place[code >= 0], return_counts=True)
                row, term = np.divmod(place, max(len(words.dictionary), 1))
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), words.dictionary.take(pa.array(term)), pa.array(n.astype(np.int64))], names=[doc_col, "term", "tf"])

    tf = cut_lineage(docs.select(doc_col, arr_col).mapInArrow(counted, f"{bl.fields(docs, [doc_col])}, term {kind}, tf long"))
    again = bl.repeated(docs, [doc_col])
    if again.isEmpty():
        return tf
    again = again.withColumnRenamed(doc_col, "__doc")
    same = tf[doc_col].eqNullSafe(again["__doc"])
    summed = tf.join(again, same, "left_semi").groupBy(doc_col, "term").agg(F.sum("tf").alias("tf"))
    return tf.join(again, same, "left_anti").unionByName(summed)


def bag_of_words(docs: DataFrame, arr_col: str, doc_col: str,
                 max_features: int | None = None, min_df: int | None = None) -> DataFrame:
    """Sparse (doc, term, tf) triples restricted to the vocabulary.

    Vocabulary = terms with document frequency >= min_df, then the
    max_features most frequent by corpus count (ties: term asc); the term
    index is alphabetical, as in the reference.
    """
    tf = term_counts(docs, arr_col, doc_col)
    terms = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if min_df is not None:
        terms = terms.where(F.col("df") >= min_df)
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    terms = cut_lineage(global_index(terms.select("term"), [F.asc("term")], "term_idx"))  # its size decides the join
    return tf.join(terms, "term")


def keras_index(tokens: DataFrame, order_cols, token_col: str = "token") -> DataFrame:
    """Index from 1 by count desc, ties by first appearance."""
    f = tokens.groupBy(F.col(token_col).alias("symbol")).agg(
        F.count(F.lit(1)).alias("freq"), F.min(F.struct(*order_cols)).alias("__first"))
    return global_index(f, [F.desc("freq"), F.asc("__first")], "idx", 1).drop("__first")


def _sequences(df: DataFrame, arr_col: str, vocab: DataFrame, out: str, unk_idx: int | None, keys: list[str]):
    """((keys..., out) of the rows whose keys stand in one row, the keys of several rows, (keys..., out) of these keys)."""
    again = bl.repeated(df, keys).dropna()
    several = not again.isEmpty()
    once = df.join(again, keys, "left_anti") if several else df
    blocks = bl.coded(once, keys, arr_col)
    known = bl.found(blocks, vocab.select(F.col("symbol").alias("__symbol"), F.col("idx").cast("long").alias("idx")), "__symbol")

    def looked_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        codes = rows.column("codes").combine_chunks()
        length, code = pc.list_value_length(codes).to_numpy().astype(np.int64), codes.flatten().to_numpy()
        ids = np.full(int(code.max(initial=-1)) + 2, 0 if unk_idx is None else unk_idx, np.int64)  # the last one stands for nulls
        hit = np.full(len(ids), unk_idx is not None)
        at = known.column("at").to_numpy()
        ids[at], hit[at] = known.column("idx").to_numpy(), True
        kept = hit[code]
        length = np.bincount(np.repeat(np.arange(len(length)), length)[kept], minlength=len(length))
        return pa.table({**{k: rows.column(k) for k in keys}, out: bl.listed(length, pa.array(ids[code][kept]))})

    seq = blocks.drop("words").groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(looked_up, f"{bl.fields(df, keys)}, `{out}` array<long>")
    if not several:
        return seq, None, None
    toks = token_table(df.join(again, keys, "left_semi").select(*keys, arr_col), arr_col, keys)
    return seq, again, collect_sequence(encode(toks, vocab, "token", unk_idx, "__id"), keys, "pos", "__id", out)


def encode_rows(df: DataFrame, arr_col: str, vocab: DataFrame, out: str = "ids", unk_idx: int | None = 0, keys=None) -> DataFrame:
    """`encode_arrays` of every row of ``df``, its keys and ``out`` alone."""
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    seq, again, summed = _sequences(df, arr_col, vocab, out, unk_idx, keys)
    none = F.array().cast("array<long>")
    nameless = F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
    seq = seq.select(*keys, F.when(nameless, none).otherwise(F.col(out)).alias(out))
    if again is None:
        return seq
    rows = df.join(again, keys, "left_semi").select(*keys).join(summed, keys, "left")
    return seq.unionByName(rows.select(*keys, F.coalesce(F.col(out), none).alias(out)))


def encode_arrays(df: DataFrame, arr_col: str, vocab: DataFrame, out: str = "ids", unk_idx: int | None = 0,
                  keys=None) -> DataFrame:
    """V5 over whole sequences: array<string> -> array<long>, order kept.

    The words of a block of rows meet the vocabulary once each; rows with equal
    keys are one sequence, exploded, joined and re-collected. A row without
    known symbols has an empty array. The vocabulary is never collected."""
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    seq, again, summed = _sequences(df, arr_col, vocab, out, unk_idx, keys)
    seq = seq if again is None else seq.unionByName(summed)
    return df.join(seq, keys, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<long>")))


def decode_arrays(df: DataFrame, ids_col: str, vocab: DataFrame, unk: str = "<UNK>", out: str = "symbols",
                  keys=None) -> DataFrame:
    """V6 over whole sequences: array<long> -> array<string> (misses -> unk, an empty row stays an empty array)."""
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    rows = df.select(*keys, F.posexplode(ids_col).alias("pos", "__i"))
    dec = decode(rows, vocab, "__i", unk, "__sym")
    seq = collect_sequence(dec, keys, "pos", "__sym", out)
    return df.join(seq, keys, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))

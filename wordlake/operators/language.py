"""Language identification as a profile-scoring job.

Profiles: character-trigram log-probabilities per language, trained from
labelled rows, over all trigrams of a language. Scoring: sum
count x (log p - log p_unseen) per language, keep the best. Texts with no
profile trigram get NULL (the reference returns False on failure).

Trigrams are numbered and counted by blocks of texts, in Arrow batches; a
block's distinct trigrams meet the profiles once each, and its texts get
their scores from what was found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.functions.text import trigram_text
from wordlake.operators import blocks as bl
from wordlake.session import cut_lineage

#: Characters of the texts whose trigrams are numbered together, about.
CHARACTERS = 1 << 22


def _trigrams(texts: pa.Array, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, trigram) of every place of a text that three characters follow: those that the pattern
    ``(?s)(?=(.{3}))`` captures. The pattern steps by UTF-16 units, so a character beyond 16 bits counts again from
    its second half, which reads as a question mark."""
    char = np.frombuffer("".join(x for x in texts.to_pylist() if x).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    after = np.arange(1, len(char) + 1)
    wide = char > 0xFFFF
    if wide.any():
        units = 1 + wide.astype(np.int64)
        first = np.cumsum(units) - units
        row, char = np.repeat(row, units), np.repeat(char, units)
        after = np.arange(1, len(char) + 1)
        after[first[wide]] += 1
        char[first[wide] + 1] = 0x3F
    if not len(char):
        return row, char
    second = np.minimum(after, len(char) - 1)
    third = np.minimum(after[second], len(char) - 1)
    ok = (after < len(char)) & (after[second] < len(char)) & (row[third] == row)
    return row[ok], (char << 42 | char[second] << 21 | char[third])[ok]


def _names(code: np.ndarray) -> pa.Array:
    both = np.stack((code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF), axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([both[i : i + 3] for i in range(0, len(both), 3)], pa.string())


def _counted(texts: pa.Array):
    """(first row, row after the last, names of the trigrams, row, number of the trigram, count), block by block."""
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64)
    for lo, hi, _, _ in bl.cuts(length, CHARACTERS):
        row, code = _trigrams(texts.slice(lo, hi - lo), length[lo:hi])
        code, number = np.unique(code, return_inverse=True)
        place, n = np.unique(row * max(len(code), 1) + number, return_counts=True)
        yield lo, hi, _names(code), *np.divmod(place, max(len(code), 1)), n


def train_profiles(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    norm = labelled.select(F.col(lang_col).alias("lang"), trigram_text(text_col).alias("__t"))

    def counted(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode(null_encoding="encode")
            for lo, _, names, row, number, n in _counted(batch.column(1)):
                lang = langs.indices.to_numpy().astype(np.int64)[row + lo]
                place, at = np.unique(lang * max(len(names), 1) + number, return_inverse=True)
                lang, number = np.divmod(place, max(len(names), 1))
                total = np.bincount(at, weights=n, minlength=len(place)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), names.take(pa.array(number)), pa.array(total)], names=["lang", "tri", "c"])

    counts = norm.mapInArrow(counted, f"{bl.fields(norm, ['lang'])}, tri string, c long").groupBy("lang", "tri").agg(F.sum("c").alias("c"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("v"))
    j = counts.join(totals, "lang")
    return j.select("lang", "tri", (F.log(F.col("c") + 1) - F.log(F.col("total") + F.col("v"))).alias("logp"),
                    (-F.log(F.col("total") + F.col("v"))).alias("floor"))


def _scores(norm: DataFrame, keys: list[str], profiles: DataFrame) -> DataFrame:
    """(keys..., lang, score) of the texts ``__t`` and the languages that know one of their trigrams, row by row."""
    names = [*keys, "block", "codes", "counts", "words"]

    def numbered(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, words, row, number, n in _counted(batch.column(len(keys))):
                length = np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(len(keys))), pa.array(np.full(hi - lo, block)),
                     bl.listed(length, pa.array(number.astype(np.int32))), bl.listed(length, pa.array(n.astype(np.int32))), bl.first_of(hi - lo, words)], names=names)
                block += 1

    kinds = bl.fields(norm, keys)
    blocks = cut_lineage(norm.select(*keys, "__t").mapInArrow(numbered, f"{kinds}, block long, codes array<int>, counts array<int>, words array<string>"))
    gains = profiles.groupBy("tri").agg(F.collect_list(F.struct("lang", (F.col("logp") - F.col("floor")).alias("gain"))).alias("gains"))
    found = bl.found(blocks, gains, "tri")

    def scored(rows: pa.Table, found: pa.Table) -> pa.Table:
        codes = rows.column("codes").combine_chunks()
        length, code = pc.list_value_length(codes).to_numpy(), codes.flatten().to_numpy()
        n, row = rows.column("counts").combine_chunks().flatten().to_numpy(), np.repeat(np.arange(rows.num_rows), length)
        lists = found.column("gains").combine_chunks()
        at = np.repeat(found.column("at").to_numpy(), pc.list_value_length(lists).to_numpy())
        flat = lists.flatten()
        langs, gain = flat.field("lang").dictionary_encode(), flat.field("gain").to_numpy()
        parts = []
        for k in range(len(langs.dictionary)):
            mine = langs.indices.to_numpy() == k
            value, hit = np.zeros(int(code.max(initial=0)) + 1), np.zeros(int(code.max(initial=0)) + 1, bool)
            value[at[mine]], hit[at[mine]] = gain[mine], True
            score = np.bincount(row, weights=n * value[code], minlength=rows.num_rows)
            some = pa.array(np.flatnonzero(np.bincount(row[hit[code]], minlength=rows.num_rows)))
            parts.append(pa.table({**{c: rows.column(c).take(some) for c in keys}, "lang": langs.dictionary.take(pa.array(np.full(len(some), k))),
                                   "score": pa.array(score).take(some)}))
        return pa.concat_tables(parts) if parts else pa.table({**{c: rows.column(c).slice(0, 0) for c in keys}, "lang": langs.dictionary.slice(0, 0), "score": pa.array([], pa.float64())})

    return blocks.drop("words").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(scored, f"{kinds}, {bl.fields(profiles, ['lang'])}, score double")


def detect(texts: DataFrame, key: str, text_col: str, profiles: DataFrame, out: str = "lang_detected") -> DataFrame:
    """Best-scoring language per text (NULL when nothing matches)."""
    norm = texts.select(key, trigram_text(text_col).alias("__t"))
    s = _scores(norm, [key], profiles).groupBy(key, "lang").agg(F.sum("score").alias("score"))  # rows with one key are one text
    best = s.groupBy(key).agg(F.max_by("lang", F.struct("score", F.col("lang"))).alias(out))
    return texts.select(key).join(best, key, "left")


def detect_with_fallback(df: DataFrame, key: str, cols, profiles: DataFrame, out: str = "lang_detected") -> DataFrame:
    """The first column (in order) whose text yields a language. All columns meet the profiles in one join."""
    norm = df.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("t"))
                                              for i, c in enumerate(cols)])).alias("__c")) \
        .where(F.length("__c.t") > 0).select(key, F.col("__c.i").alias("__i"), trigram_text("__c.t").alias("__t"))
    s = _scores(norm, [key, "__i"], profiles).groupBy(key, "__i", "lang").agg(F.sum("score").alias("score"))
    best = s.groupBy(key).agg(F.max_by("lang", F.struct(-F.col("__i"), "score", F.col("lang"))).alias(out))
    return df.select(key).join(best, key, "left")

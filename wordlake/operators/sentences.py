r"""Sentences with abbreviations learned from the corpus, without a word list.

After the published unsupervised method (Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection", 2006):
a word is an abbreviation if it stands with its period more often than chance, by a log-likelihood ratio that long words,
words without inner periods and words seen without the period lose. The counts are one aggregate over all tokens. A
period after a word that is no abbreviation and no single letter ends a sentence; after one that is, only if the next
word is capitalized although the corpus mostly writes it in lower case. Question and exclamation marks always end one.

What a period means depends on the two words beside it alone, and each of them counts by itself. So the rows are taken
together in blocks (`blocks`), the patterns meet a block's distinct tokens, and places are counted and judged by their
numbers; no row is made for a place. Sentences are cut from each text's own tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordlake.operators import blocks as bl
from wordlake.session import cut_lineage

SPACE = r"[ \t\n\r\f]+"
OPENING, CLOSING = r"[\"'(\[]", r"[\"')\]]"
#: Score from which a word is an abbreviation, and the chance of its period if it is one (published values).
THRESHOLD, CERTAIN = 0.3, 0.99


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _core(token: str) -> Column:
    """The word of a token: without quotes, brackets and marks at its ends, and without one last period, in lower case."""
    inner = F.regexp_replace(token, rf"^{OPENING}+|[\"')\],;:!?]+$", "")
    return F.lower(F.regexp_replace(inner, r"\.$", ""))


def _ends_in(token: str, marks: str) -> Column:
    return F.coalesce(F.col(token).rlike(rf"[{marks}]{CLOSING}*$"), F.lit(False))


def _upper(token: str) -> Column:
    return F.col(token).rlike(rf"^{OPENING}*\p{{Lu}}")


def _blocks(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return bl.coded(texts.select(*keys, tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0), keys, "w")


def _marked(blocks: DataFrame) -> DataFrame:
    """(of_block, at, word, period, ending, mark, lower, upper) of every distinct token of a block, written once: its word,
    and whether it ends in a period, in an end mark of any kind, in ``!`` or ``?``, and begins in lower or upper case."""
    words = blocks.where(F.size("words") > 0).select(F.col("block").alias("of_block"), F.posexplode("words").alias("at", "cur"))
    return cut_lineage(words.select("of_block", "at", _core("cur").alias("word"), _ends_in("cur", ".").alias("period"), _ends_in("cur", ".!?").alias("ending"),
                                    _ends_in("cur", "!?").alias("mark"), F.col("cur").rlike(rf"^{OPENING}*\p{{Ll}}").alias("lower"), _upper("cur").alias("upper")))


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all rows, the rows' lengths, and for every place whether one of its row follows."""
    codes = rows.column("codes").combine_chunks()
    length, code = pc.list_value_length(codes).to_numpy().astype(np.int64), codes.flatten().to_numpy()
    goes_on = np.ones(len(code), bool)
    goes_on[np.cumsum(length) - 1] = False  # no row is empty
    return code, length, goes_on


def _by_code(marks: pa.Table, name: str) -> np.ndarray:
    out = np.zeros(marks.num_rows, bool)
    out[marks.column("at").to_numpy()] = marks.column(name).to_numpy()
    return out


def word_statistics(blocks: DataFrame, marked: DataFrame) -> DataFrame:
    """(word, n, n_period, n_lower, n_upper_inside): per word, all its tokens, those with a period, those that begin in
    lower case, and capitalized ones that follow a token without an end mark."""
    def counted(rows: pa.Table, marks: pa.Table) -> pa.Table:
        code, _, goes_on = _flat(rows)
        at = marks.column("at").to_numpy()
        n = np.bincount(code, minlength=len(at))[at]
        inside = np.bincount(code[1:][(goes_on & ~_by_code(marks, "ending")[code])[:-1]], minlength=len(at))[at]
        of = lambda name: marks.column(name).to_numpy()
        return pa.table({"word": marks.column("word"), "n": n, "n_period": n * of("period"), "n_lower": n * of("lower"), "n_upper_inside": inside * of("upper")})

    counts = blocks.select("block", "codes").groupBy("block").cogroup(marked.groupBy("of_block")).applyInArrow(
        counted, "word string, n long, n_period long, n_lower long, n_upper_inside long")
    return counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "n_period", "n_lower", "n_upper_inside")))


def abbreviation_scores(stats: DataFrame) -> DataFrame:
    """``stats`` with ``score``; 0 for words without a letter."""
    total = stats.agg(F.sum("n").alias("all_n"), F.sum("n_period").alias("all_period"))  # one row
    s = stats.crossJoin(F.broadcast(total))
    p = F.col("all_period") / F.col("all_n")
    a, rest = F.col("n_period"), F.col("n") - F.col("n_period")
    none = lambda times, chance: F.when(times > 0, times * F.ln(chance)).otherwise(0.0)
    chance = none(a, p) + none(rest, 1 - p)
    ratio = -2 * (chance - (a * F.ln(F.lit(CERTAIN)) + rest * F.ln(F.lit(1 - CERTAIN))))
    length = F.char_length(F.replace(F.col("word"), F.lit("."), F.lit(""))).cast("double")
    periods = F.char_length("word") - length + 1
    score = ratio * F.exp(-length) * periods * F.pow(length, -rest)
    fits = (length > 0) & F.col("word").rlike(r"\p{L}") & (a > 0) & (p < CERTAIN)
    return s.withColumn("score", F.when(fits, score).otherwise(0.0)).drop("all_n", "all_period")


def abbreviations(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, n_period, score) of the words that the corpus uses as abbreviations, without their last period."""
    blocks = _blocks(texts, [], text_col)
    return abbreviation_scores(word_statistics(blocks, _marked(blocks))).where(F.col("score") >= THRESHOLD).select("word", "n", "n_period", "score")


def split_sentences(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, sent_id from 0, tokens) of every sentence of ``texts`` (``key`` unique). Null and blank texts have none, and a
    text without a key is one sentence."""
    blocks = _blocks(texts, [key], text_col)
    marked = _marked(blocks)
    stats = abbreviation_scores(word_statistics(blocks, marked)).select(
        "word", ((F.col("score") >= THRESHOLD) | F.col("word").rlike(r"^\p{L}$")).alias("short"), (F.col("n_lower") > F.col("n_upper_inside")).alias("common"))
    judged = marked.join(stats, "word").select(
        "of_block", "at", (F.col("period") & ~F.col("short")).alias("stops"), (F.col("period") & F.col("short")).alias("may_stop"), "mark",
        (F.col("upper") & F.col("common")).alias("starts"))

    def cut(rows: pa.Table, marks: pa.Table) -> pa.Table:
        code, length, goes_on = _flat(rows)
        stops, may_stop, mark, starts = (_by_code(marks, c)[code] for c in ("stops", "may_stop", "mark", "starts"))
        ends = mark | goes_on & (stops | may_stop & np.append(starts[1:], False))
        ends &= np.repeat(rows.column(key).is_valid().to_numpy(), length)
        ends |= ~goes_on
        last = np.flatnonzero(ends)
        row = np.repeat(np.arange(len(length)), length)[last]
        first_of_row = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        sent_id = np.arange(len(row)) - np.repeat(first_of_row, np.diff(np.append(first_of_row, len(row))))
        words = rows.column("words").combine_chunks().flatten()
        return pa.table({key: rows.column(key).take(pa.array(row)), "sent_id": pa.array(sent_id, pa.int32()),
                         "tokens": bl.listed(np.diff(np.append(-1, last)), words.take(pa.array(code)))})

    return blocks.groupBy("block").cogroup(judged.groupBy("of_block")).applyInArrow(cut, f"{bl.fields(texts, [key])}, sent_id int, tokens array<string>")


def sentence_words(sentences: DataFrame, key: str) -> DataFrame:
    """(key, sent_id, words): lower-case words of every sentence, marks at their ends removed, empty ones left out."""
    word = lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))
    return sentences.select(key, "sent_id", F.array_remove(F.transform("tokens", word), "").alias("words"))

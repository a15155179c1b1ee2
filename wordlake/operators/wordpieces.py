"""Word pieces by greedy longest match, and labels of characters carried to them.

A vocabulary holds word starts and continuations (marked ``##``). A word is cut from its start into the longest piece
that the vocabulary has at each place; a word with a place where none fits is one unknown piece. The vocabulary is
bounded (``MOST_PIECES``), travels to the tasks once and is walked as a trie; every distinct word is cut once and joined
back to its places, so a word that fills a third of the corpus costs one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN, JOINT = "[UNK]", "##"
MOST_PIECES = 200_000


def trie_of(pieces: list[str]) -> dict:
    """Nested dictionaries by character; the key "" marks the end of a piece. Continuations lie below ``JOINT``."""
    root: dict = {JOINT: {}}
    for piece in pieces:
        node, rest = (root[JOINT], piece[len(JOINT):]) if piece.startswith(JOINT) and piece != JOINT else (root, piece)
        for c in rest:
            node = node.setdefault(c, {})
        if rest:
            node[""] = True
    return root


def cut_word(word: str, trie: dict) -> list[int]:
    """Ends of the pieces of a word; an empty list if it is unknown."""
    ends: list[int] = []
    at, start = 0, trie
    while at < len(word):
        node, best = start, -1
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                best = i + 1
        if best < 0:
            return []
        ends.append(best)
        at, start = best, trie[JOINT]
    return ends


def cut_words(words: DataFrame, pieces: DataFrame, word_col: str = "word", piece_col: str = "piece") -> DataFrame:
    """(word, pieces, ends) of every distinct non-empty word; ``ends`` are character offsets. ``pieces`` has at most
    MOST_PIECES distinct rows."""
    rows = [r[0] for r in pieces.select(piece_col).where(F.col(piece_col) != "").distinct().limit(MOST_PIECES + 1).collect()]
    if len(rows) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    sent = words.sparkSession.sparkContext.broadcast(sorted(rows))

    def cut(batches):
        trie = trie_of(sent.value)
        for batch in batches:
            found, ends = [], []
            for word in batch.column(0).to_pylist():
                stops = cut_word(word, trie)
                starts = [0, *stops[:-1]]
                found.append([(JOINT if a else "") + word[a:b] for a, b in zip(starts, stops)] or [UNKNOWN])
                ends.append(stops or [len(word)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=["word", "pieces", "ends"])

    distinct = words.select(F.col(word_col).alias("word")).where("word <> ''").distinct()
    return distinct.mapInArrow(cut, "word string, pieces array<string>, ends array<int>")


def align(tokens: list[str], raw: str) -> list[int]:
    """End offsets in ``raw`` (the words without spaces) of pieces of which only the strings are known.

    A known piece stands where the one before ends. An unknown one reaches to the next place where the known pieces
    behind it (up to the next unknown one) fit one after the other, or to the end; unknown pieces in a row share what
    lies between: all but the last have one character."""
    ends: list[int] = []
    at, i = 0, 0
    while i < len(tokens):
        if tokens[i] != UNKNOWN:
            at += len(tokens[i].removeprefix(JOINT))
            ends.append(at)
            i += 1
            continue
        j = i
        while j < len(tokens) and tokens[j] == UNKNOWN:
            j += 1
        k = j
        while k < len(tokens) and tokens[k] != UNKNOWN:
            k += 1
        known = "".join(t.removeprefix(JOINT) for t in tokens[j:k])
        least = at + (j - i)
        stop = (len(raw) - len(known) if k == len(tokens) else raw.find(known, least)) if known else len(raw)
        ends += [*range(at + 1, at + (j - i)), stop]
        at, i = stop, j
    return ends


def piece_labels(docs: DataFrame, words_col: str, keys, pieces: DataFrame) -> DataFrame:
    """(keys..., tokens, labels) of rows with an array of words each (non-empty strings): labels[i] is the mark of the last character of
    tokens[i], and a character's mark is 1 where it ends a word. Rows without words have empty arrays."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    places = docs.select(*keys, F.posexplode(words_col).alias("pos", "word"))
    cut = cut_words(places, pieces)
    labelled = cut.select("word", "pieces", F.transform("ends", lambda e: (e == F.char_length("word")).cast("int")).alias("marks"))
    rows = places.join(labelled, "word").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "pieces", "marks"))).alias("r"))
    rows = rows.select(*keys, F.flatten(F.transform("r", lambda x: x["pieces"])).alias("tokens"), F.flatten(F.transform("r", lambda x: x["marks"])).alias("labels"))
    return docs.select(*keys).join(rows, keys, "left").select(
        *keys, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))


def realigned_labels(rows: DataFrame, token_col: str, raw_col: str, mark_col: str, out: str = "labels") -> DataFrame:
    """``rows`` with the label of each piece where only piece strings, raw text and marks per character are known."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, {out} array<int>"

    def run(batches):
        for batch in batches:
            labels = []
            for tokens, raw, marks in zip(*(batch.column(c).to_pylist() for c in (token_col, raw_col, mark_col))):
                marks = np.asarray(marks or [], np.int32)
                labels.append(marks[np.asarray(align(tokens or [], raw or ""), np.int64) - 1].tolist() if tokens else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)

"""Operator 12, spelling variant grouping by a dictionary of trie-node pairs.

Every node of the trie of all words (a prefix) and of the trie of all reversed words (a suffix) gets an integer. A word
then stands in the dictionary under the pair (prefix node, suffix node) around each code point that it skips, and under
the pair around each gap between code points. Two words differ by one replaced code point exactly if they skip it
between the same nodes; a word lacks one inserted code point of another exactly if its gap lies between the nodes around
that code point. Equal integers mean equal strings, so the pairs are the neighbours themselves and nothing is verified.

A pair of nodes holds at most one word by a gap and one per letter by skips, so groups are bounded by the alphabet, and
windows over a group count its members and name the best other one; the pairs within a group are never made. In a
stretch of equal code points only the first is skipped for insertions, so no two words meet twice.

The tries are numbered from words sorted over partitions: a node's number is the place of its first word among all the
letters of the sorted words, plus its depth. A task walks the sorted words of one part and compares each word with the
one before. Only prefixes that reach over a part's end need more: they are prefixes of the part's first or last word, and
the driver numbers them from these (two words a part).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordlake.llm.textblocks import trimmed_group
from wordlake.session import cut_lineage

OTHER = r"[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word) for every maximal run of letters of every text, A-Z in lower case; null texts have none."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(F.col(text_col), OTHER)).alias("run")).where("run <> ''")
    upper = F.col("run").rlike("[A-Z]")
    return runs.select("doc_id", F.when(upper, F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("word"))


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # a[:lo] equal, a[:hi + 1] not
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _shared_nodes(ends: list[tuple[str, str]]) -> list[list[int]]:
    """For each part's (first, last word): numbers below 0 of the nodes that its first word shares with the part before,
    by depth. A node that reaches over several parts' ends keeps its number."""
    out: list[list[int]] = [[]]
    free = -1
    for k in range(1, len(ends)):
        depth = _common(ends[k - 1][1], ends[k][0])
        kept = min(len(out[-1]) - 1, _common(ends[k - 1][0], ends[k][0]), depth)
        new = depth - kept
        out.append(out[-1][: kept + 1] + list(range(free, free - new, -1)))
        free -= new
    return out


def trie_nodes(words: DataFrame, column: str, out: str) -> DataFrame:
    """``words`` with ``out``, the trie node of every prefix of ``column`` (distinct, not null) by depth from 0, and
    ``out_order``, numbers that rise with the words. Equal prefixes have equal nodes, others never."""
    parts = cut_lineage(words.repartitionByRange(column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id()))
    ends = parts.groupBy("part").agg(F.min(column).alias("first"), F.max(column).alias("last"), F.sum(F.char_length(column) + 1).alias("size"))
    ends = sorted(ends.collect())  # a row a part
    shared = _shared_nodes([(r["first"], r["last"]) for r in ends])
    starts = np.concatenate(([0], np.cumsum([r["size"] for r in ends], dtype=np.int64)))
    place = {r["part"]: (int(starts[k]), shared[k], r["last"], shared[k + 1] if k + 1 < len(ends) else []) for k, r in enumerate(ends)}
    carried = words.columns

    def number(table: pa.Table) -> pa.Table:
        base, before, last, after = place[table.column("part")[0].as_py()]
        table = table.take(pc.sort_indices(table.column(column).cast(pa.binary())))
        nodes, order = [], []
        previous, stack = None, before  # the nodes of the word before
        for word in table.column(column).to_pylist():
            kept = len(before) - 1 if previous is None else _common(previous, word)
            reach = min(_common(word, last), len(after) - 1)
            stack = stack[: kept + 1] + [after[d] if d <= reach else base + d for d in range(kept + 1, len(word) + 1)]
            nodes.append(stack)
            order.append(base)
            base += len(word) + 1
            previous = word
        return table.select(carried).append_column(out, pa.array(nodes, pa.list_(pa.int64()))).append_column(f"{out}_order", pa.array(order, pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return parts.groupBy("part").applyInArrow(trimmed_group(number), f"{fields}, {out} array<long>, {out}_order long")


def node_pairs(nodes: DataFrame) -> DataFrame:
    """(p, s, id, n, gap, first) of all words of ``nodes`` (word, n, id, prefixes, suffixes): the nodes around every skipped
    code point (``first`` if the one before differs) and around every gap."""
    length = F.char_length("word")
    r = nodes.select("id", "n", "word", "prefixes", F.reverse("suffixes").alias("suffixes"), length.alias("length"))
    at = F.col("at")
    # suffixes[i] is now what follows i code points
    skips = r.select("id", "n", F.posexplode(F.arrays_zip(
        F.slice("prefixes", F.lit(1), F.col("length")).alias("p"), F.slice("suffixes", F.lit(2), F.col("length")).alias("s"), F.split("word", "").alias("c"),
        F.concat(F.array(F.lit("")), F.split("word", "")).alias("b"))).alias("at", "x"), "length").where(at < F.col("length"))
    skips = skips.select("x.p", "x.s", "id", "n", F.lit(False).alias("gap"), (F.col("x.c") != F.col("x.b")).alias("first"))
    gaps = r.select("id", "n", F.explode(F.arrays_zip(F.col("prefixes").alias("p"), F.col("suffixes").alias("s"))).alias("x"))
    return skips.unionByName(gaps.select("x.p", "x.s", "id", "n", F.lit(True).alias("gap"), F.lit(False).alias("first")))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best (n, -id)) of the words that have a near word."""
    group = Window.partitionBy("p", "s")
    order = group.orderBy("gap", F.desc("n"), "id")
    one = F.struct(F.col("n").alias("n"), (-F.col("id")).alias("minus_id"))
    skip = ~F.col("gap")
    w = pairs.withColumn("one", one)
    w = w.select(
        "id", "gap", "first", "one", F.count("*").over(group).alias("size"), F.sum(skip.cast("long")).over(group).alias("skips"),
        F.max(F.when(skip, F.col("one"))).over(group).alias("top"), F.lead(F.when(skip, F.col("one"))).over(order).alias("second"),
        F.max(F.when(F.col("gap"), F.col("one"))).over(group).alias("shorter"),
        F.sum(F.col("first").cast("long")).over(group).alias("longer_n"), F.max(F.when(F.col("first"), F.col("one"))).over(group).alias("longer"))
    w = w.where("size > 1")
    other = F.when(F.col("one") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    below = F.when(F.col("first"), F.col("shorter"))
    near = F.when(F.col("gap"), F.col("longer_n")).otherwise(F.col("skips") - 1 + below.isNotNull().cast("long"))
    best = F.when(F.col("gap"), F.col("longer")).otherwise(F.greatest(other, below))
    return w.select("id", near.alias("n_near"), best.alias("best")).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")).where("n_near > 0")


def _ends(forms: DataFrame) -> DataFrame:
    """(id, to) of ``forms`` with ``to`` followed to its end, by doubling: every form has at least RATIO times the count of
    its word, so the number of steps is the logarithm of a logarithm of the largest count."""
    step = forms
    while True:
        jump = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = cut_lineage(step.join(jump, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("id", "to")
        if moved.where("moved").isEmpty():
            return step


def spelling_variants(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per distinct ``word`` of at least ``min_length`` code points and ``min_count`` rows: word, form, root, n,
    n_near, form_n.

    Near words differ by one inserted, deleted or replaced code point. ``form`` is the near word of largest n (ties: the
    smallest in code-point order) if that is at least ``ratio`` (2 or more) times the word's n, else null; ``root`` follows forms
    to the last and is the word itself if it has none. Null words are left out; extra columns are not read; no words give
    no rows. Words may be long: memory is a few numbers per code point of a part's words.
    """
    counted = words.where(F.char_length("word") >= max(1, min_length)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    forward = trie_nodes(counted, "word", "prefixes").withColumnRenamed("prefixes_order", "id")
    both = trie_nodes(forward.withColumn("reversed", F.reverse("word")), "reversed", "suffixes")
    known = cut_lineage(both.select("id", "word", "n", "prefixes", "suffixes"))
    near = cut_lineage(neighbours(node_pairs(known)))
    table = known.select("id", "word", "n")
    best = near.select("id", "n_near", (-F.col("best.minus_id")).alias("to"), F.col("best.n").alias("form_n"))
    rows = cut_lineage(table.join(best, "id", "left").withColumn("to", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("to"))))
    ends = _ends(rows.where("to is not null").select("id", "to")).withColumnRenamed("to", "end")
    names = table.select("id", "word")
    out = rows.join(names.select(F.col("id").alias("to"), F.col("word").alias("form")), "to", "left")
    out = out.join(ends, "id", "left").join(names.select(F.col("id").alias("end"), F.col("word").alias("last")), "end", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                      F.when(F.col("to").isNotNull(), F.col("form_n")).alias("form_n"))

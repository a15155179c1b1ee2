import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from wordlake.llm import queries, spelling
from wordlake.llm.spelling import document_words, spelling_variants, trie_nodes
from wordlake.sources.tables import table

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, min_length=6, min_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items())


def got(words, **options):
    out = spelling_variants(words, **options)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def table_of(spark, counts, parts=5):
    return spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string").repartition(parts)


@pytest.mark.parametrize("seed,letters,length,parts", [(1, "ab", 9, 3), (2, "abc", 4, 8), (3, "aéÿz", 5, 1), (4, "abcdefghij", 3, 13)])
def test_equals_brute_force(spark, seed, letters, length, parts):
    """Words of few letters: most have many near words, ties, chains of forms and stretches of one letter."""
    rng = random.Random(seed)
    counts = {}
    for _ in range(250):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, length + 1)))
        counts[w] = rng.choice([1, 2, 3, 10, 11, 60, 300])
    counts |= {w + rng.choice(letters): counts[w] * 5 for w in list(counts)[:20]}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert got(table_of(spark, counts, parts), min_length=2, min_count=2) == brute(counts, 2, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_nodes_are_equal_exactly_for_equal_prefixes(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(400)} | {"aaaaaaa" + "b" * k for k in range(40)})
    many = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, extra int")
    for parts in (1, 7, 60):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows = trie_nodes(many, "word", "nodes").collect()
        assert sorted(r["word"] for r in rows) == words
        by_prefix = {}
        for r in rows:
            assert len(r["nodes"]) == len(r["word"]) + 1
            for d, node in enumerate(r["nodes"]):
                assert by_prefix.setdefault(r["word"][:d], node) == node
        assert len(set(by_prefix.values())) == len(by_prefix)
        ordered = sorted(rows, key=lambda r: r["nodes_order"])
        assert [r["word"] for r in ordered] == words
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_odd_words(spark, odd_docs, no_docs):
    empty = spark.createDataFrame([], "doc_id long, word string")
    assert got(empty) == [] and got(document_words(no_docs)) == []
    long = "ab" * 3000
    counts = {long: 30, long[:-1]: 5, long[:100] + "z" + long[101:]: 6, "ab" * 50: 7, "": 9}
    assert got(table_of(spark, counts)) == brute(counts)
    rows = spark.createDataFrame([(None, 1)] * 9 + [("rather", 1)] * 25 + [("rathr", 2)] * 5 + [("rathir", 2)] * 5, "word string, n int")
    assert got(rows) == [("rather", None, "rather", 25, 1, None), ("rathir", "rather", "rather", 5, 1, 25)]
    words = {r["word"] for r in document_words(odd_docs).collect()}
    assert "spam" in words and "é" * 700 in words and None not in words and "" not in words


def test_query_equals_brute_force(spark):
    """The whole query on the smallest table, its misspellings from the definition."""
    counts = {}
    for doc_id, text in table(spark, SF001, "documents").select("doc_id", "text").toLocalIterator():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    rows = queries.op12_spelling_variants(spark, SF001)
    assert sorted(tuple(r) for r in rows.collect()) == brute(counts)
    assert dict(rows.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert rows.where(F.col("form").isNotNull()).count() > 0

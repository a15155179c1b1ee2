import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from wordlake.llm import queries, winnowing
from wordlake.llm.winnowing import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(winnowing.UPPER, winnowing.LOWER)
ITEMS = "item_id long, text string, low string, span int"


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, span=10):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, ids = tokens(text), set(), set()
        for item, body, *_ in items:
            b = tokens(body)
            n = min(span, len(b))
            stretches = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in stretches]
            hit |= {j for i in at for j in range(i, i + n)}
            ids |= {str(item)} if at and item is not None else set()
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def got(spark, docs, items, schema="doc_id long, text string, lang string, source string, n_chars long, kept string, word string", **options):
    d = spark.createDataFrame(docs, schema) if isinstance(docs, list) else docs
    out = decontaminate(d, spark.createDataFrame(items, ITEMS), **options)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def made(seed, n_docs, n_items, letters):
    """Texts of few words, so that parts of stretches are common, with planted items of all lengths, ties and repeats."""
    rng = random.Random(seed)
    word = lambda: rng.choice(letters)
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 9, 10, 11, 14, 40]))), "x", 1) for i in range(n_items)]
    items += [items[0], (None, items[-1][1], None, None), (900, None, None, None)]
    docs = []
    for i in range(n_docs):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(3)):
            body = rng.choice(items)[1] or ""
            cut = body.split()[rng.randrange(3) :]
            parts += [" ".join(cut).upper(), " ".join(word() for _ in range(rng.randrange(0, 12)))]
        docs.append((i, "; ".join(parts), "en", "s", 1, "k", "w"))
    return docs, items


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefgh"), (3, [f"w{i}é" for i in range(300)])])
def test_all_lengths_equal_brute_force(spark, seed, letters):
    docs, items = made(seed, 60, 25, letters)
    assert got(spark, docs, items) == brute(docs, items)


def test_only_long_items_need_the_whole_stretch(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w), None, None)]
    docs = [(n, " ".join(["x"] * 3 + w[5 : 5 + n] + ["y"] * 3), None, None, None, None, None) for n in range(1, 30)]
    assert got(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11", "l", 1), (2, "one", None, None), (3, "!!", None, None),
             (4, "the cat sat the cat sat the cat sat the cat sat", None, None), (5, "漢字", None, None)]
    rows = [tuple(r) for r in odd_docs.collect()]
    assert got(spark, odd_docs, items) == brute(rows, items)
    assert got(spark, no_docs, items) == []
    assert {r[2:] == (0, []) for r in got(spark, odd_docs, [])} == {True}


def test_pieces_and_shuffles_give_the_same(spark, monkeypatch):
    docs, items = made(5, 40, 20, [f"w{i}" for i in range(30)])
    whole = brute(docs, items)
    monkeypatch.setattr(winnowing, "LONG_TEXT", 10)
    monkeypatch.setattr(winnowing, "PIECE", 7)
    monkeypatch.setattr(winnowing, "BROADCAST_BYTES", 0)
    assert got(spark, docs, items) == whole


def test_long_text(spark):
    """A text of several megabytes, cut into pieces by one pass of the pattern."""
    w = [f"q{i * 7919 % 100_003}" for i in range(400_000)]
    docs = [(1, " ".join(w), None, None, None, None, None)]
    items = [(1, " ".join(w[19_990:20_012]), None, None), (2, " ".join(w[-10:]), None, None), (3, " ".join(reversed(w[:50])), None, None)]
    row = got(spark, docs, items)[0]
    assert row[:2] == (1, 400_000) and row[3] == ["1", "2"]
    assert row[2] >= 32


def test_no_python_on_the_main_path(spark):
    plan = queries.op11_winnowing(spark, SF001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    cur = con.execute(queries.OP11_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    rows = queries.op11_winnowing(spark, SF001)
    assert rows.columns == names
    assert sorted(tuple(r) for r in rows.collect()) == want
    assert rows.where("n_items = 0 and items_sha256 <> '" + hashlib.sha256(b"").hexdigest() + "'").isEmpty()
    assert rows.agg(F.sum("n_hit")).first()[0] > 0

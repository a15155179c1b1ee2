"""Golden cases (FIXTURES sections 4 and 5) and brute-force cross-checks.

Small literal inputs here are test fixtures only; registered queries read
the driver tables.
"""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import text as tx
from wordlake.operators import cooccur as co
from wordlake.operators import dataset as ds
from wordlake.operators import evaluate as ev
from wordlake.operators import sequences as sq
from wordlake.operators import stats as st
from wordlake.operators import topics as tp
from wordlake.operators import vectors as ve
from wordlake.operators import vocab as vb


def one(spark, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema)


def test_t5_tokenize(spark):
    df = spark.createDataFrame([("a brown fox jumps over the lazy dog",),
                                ("1/2 Shouldn't \"yo\" hey, abc. time-out",)], "x string")
    got = [r[0] for r in df.select(tx.regexp_tokens("x")).collect()]
    assert got[0] == "a brown fox jumps over the lazy dog".split()
    assert got[1] == ["1", "/2", "Shouldn", "'t", '"yo"', "hey", ",", "abc", ".", "time", "-out"]


def test_t1_links_and_t4_clean(spark):
    df = one(spark, "a 1 24342 awd http://yahoo.com/test  dad good weather")
    assert df.select(tx.strip_links("x")).first()[0] == "a 1 24342 awd   dad good weather"
    assert df.select(F.array_join(tx.clean_words("x"), " ")).first()[0] == "awd dad good weather"


def test_w8_first_appearance(spark):
    toks = vb.token_table(spark.createDataFrame([(0, list("aacbab"))], "d long, w array<string>"), "w", "d")
    got = {r.symbol: r.idx for r in vb.first_appearance_index(toks, ["d", "pos"]).collect()}
    assert got == {"a": 0, "c": 1, "b": 2}


def test_w1_w5_windows(spark):
    df = spark.createDataFrame([(list("abcd"),)], "w array<string>")
    assert df.select(sq.ngrams("w", 2)).first()[0] == [["a", "b"], ["b", "c"], ["c", "d"]]
    assert df.select(sq.bigram_strings("w", "")).first()[0] == ["ab", "bc", "cd"]
    assert df.select(sq.ngrams("w", 5)).first()[0] == []


def test_w7_frequency_rank(spark):
    toks = vb.token_table(spark.createDataFrame([(0, list("abacb"))], "d long, w array<string>"), "w", "d")
    got = {r.symbol: r.idx for r in vb.frequency_vocabulary(toks).collect()}
    assert got == {"b": 0, "a": 1, "c": 2}


def test_a3_tally(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c d",)], "p string")
    assert {r.symbol: r.freq for r in vb.frequencies(df, "p").collect()} == {"a b": 2, "c d": 1}


def test_v7_pad(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6, 7],)], "a array<int>")
    got = [r[0] for r in df.select(ar.pad_left("a", 5)).collect()]
    assert got == [[0, 0, 1, 2, 3], [3, 4, 5, 6, 7]]


def _c_df(spark, s):
    return spark.createDataFrame([(s.split(),)], "w array<string>")


def _tri(df):
    return {(r.row_word, r.col_word): r.weight for r in df.collect()}


def test_c1_to_c5_golden(spark):
    df = _c_df(spark, "a b a c")
    assert _tri(co.one_sided(df, "w", 2)) == {("b", "a"): 1, ("a", "b"): 1, ("c", "b"): 1, ("c", "a"): 1}
    c2 = {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}
    assert _tri(co.two_sided(df, "w", 2)) == c2
    assert _tri(co.two_sided(df, "w", 2, skip_equal=False)) == {**c2, ("a", "a"): 2}
    assert _tri(co.window_pairs(df, "w", 2)) == {("a", "b"): 2, ("b", "a"): 2}
    assert _tri(co.normalize_total(co.window_pairs(df, "w", 2))) == {("a", "b"): 0.5, ("b", "a"): 0.5}


def _pairs_within(words, w, skip_equal=True):
    """(later, earlier) word counts over all positions p < q at most w apart."""
    return Counter((words[q], words[p]) for p, q in itertools.combinations(range(len(words)), 2)
                   if q - p <= w and not (skip_equal and words[p] == words[q]))


def _both_ways(counts):
    return counts + Counter({(b, a): n for (a, b), n in counts.items()})


def _brute_window_pairs(words, w):
    """Pairs of each slice of w words that has a word behind it, both ways."""
    c = Counter()
    for end in range(len(words)):
        for a, b in itertools.combinations(words[max(0, end - w):end], 2):
            c.update([(a, b), (b, a)])
    return c


@pytest.mark.parametrize("seed", range(4))
def test_cooccurrence_brute_force(spark, seed):
    rnd = random.Random(seed)
    streams = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 14))] for _ in range(6)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(streams)], "d long, w array<string>")
    for w in (1, 2, 3, 5):
        exp1, exp2, exp3, exp4 = Counter(), Counter(), Counter(), Counter()
        for s in streams:
            exp1 += _pairs_within(s, w)
            exp2 += _both_ways(_pairs_within(s, w))
            exp3 += _both_ways(_pairs_within(s, w, False))
            exp4 += _brute_window_pairs(s, w)
        assert _tri(co.one_sided(df, "w", w)) == dict(exp1)
        assert _tri(co.two_sided(df, "w", w)) == dict(exp2)
        assert _tri(co.two_sided(df, "w", w, skip_equal=False)) == dict(exp3)
        assert _tri(co.window_pairs(df, "w", w)) == dict(exp4)


def test_w9_skipgram_brute_force(spark):
    rnd = random.Random(7)
    streams = [[rnd.choice("xyz") for _ in range(rnd.randint(0, 9))] for _ in range(5)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(streams)], "d long, w array<string>")
    got = Counter((r.d, r.word, r.context) for r in sq.skipgram_pairs(df, "w", 2, "d").collect())
    exp = Counter()
    for d, s in enumerate(streams):
        padded = ["--", "--", *s, "--", "--"]
        exp.update((d, padded[i], padded[i + k]) for i in range(2, len(s) + 2) for k in (-2, -1, 1, 2))
    assert got == exp


def test_w11_phrase_brute_force(spark):
    s = list("abcdefg")
    df = spark.createDataFrame([(0, s)], "d long, w array<string>")
    got = sorted((r.t, r.target, r.context) for r in sq.phrase_context_pairs(df, "w", 2, 2, "d").collect())
    padded = ["--"] * 6 + s  # row t ends with word t: left, target and right are the three pairs up to it
    exp = [(t, " ".join(padded[t + 3:t + 5]), ctx) for t in range(len(s)) for ctx in padded[t + 1:t + 3] + padded[t + 5:t + 7]]
    assert got == sorted(exp)


def test_v15_closed_form(spark):
    rows = [(a, b, m) for a in range(25) for b in range(25) for m in (9, 12, 29)]
    df = spark.createDataFrame(rows, "a int, b int, m int")
    got = {}
    for m in (9, 12, 29):
        la, lb = ar.truncate_pair_lengths("a", "b", m)
        for r in df.where(F.col("m") == m).select("a", "b", la.alias("x"), lb.alias("y")).collect():
            got[(r.a, r.b, m)] = (r.x, r.y)
    for a, b, m in rows:
        x, y = got[(a, b, m)]
        assert x + y == min(a + b, m) and 0 <= x <= a and 0 <= y <= b
        if a + b > m:  # only a side longer than the other is cut; on a tie the second
            assert x == a or x == y or x == y + 1 or b == y
            assert (x, y) == ((a, m - a) if a <= m // 2 + m % 2 else (m - b, b) if b <= m // 2 else (m - m // 2, m // 2))


def test_v17_word_ends(spark):
    df = spark.createDataFrame([(["ab", "c"],)], "w array<string>")
    assert df.select(ar.word_end_labels("w")).first()[0] == [0, 1, 1]


def test_a8_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    got = {r.bin: r["count"] for r in st.histogram_edges(df, "v", [0, 5, 10]).collect()}
    assert got == {1: 1, 2: 2}


def test_a9_ecdf(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 3, 4])], "i long, v double")
    got = [r.ecdf for r in st.ecdf(df, "v").orderBy("i").collect()]
    assert got == [0.0, 0.0, 0.5, 0.75]


def test_a4_describe(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = st.describe(df, "v").first()
    assert (r.q25, r.q50, r.q75) == (1.75, 2.5, 4.75)
    assert abs(r["std"] - 4.08248) < 1e-5


def test_k5_weighted_auc(spark):
    rows = [(0, 0.0, 1.0), (1, 0.6, 1.0), (0, 0.7, 1.0), (0, 0.0, 1.0), (1, 0.6, 1.0), (0, 0.7, 0.0)]
    df = spark.createDataFrame(rows, "y int, s double, w double")
    assert abs(ev.weighted_auc(df, "s", "y", "w").first().auc - 2 / 3) < 1e-9


def test_e2_compact_embedding(spark):
    toks = vb.token_table(spark.createDataFrame([(0, ["the", "dog", "barks", "."])], "d long, w array<string>"),
                          "w", "d")
    table = {".": [0, 1, 2], "the": [1, 2, 3], "dog": [2, 3, 4], "cat": [3, 4, 5], "a": [4, 5, 6]}
    vecs = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in table.items()], "word string, vec array<double>")
    mat, cov = ve.compact_embedding(toks, vecs, ["d", "pos"], 3)
    got = [r.vec for r in mat.orderBy("idx").collect()]
    assert got == [[0, 0, 0], [1, 2, 3], [2, 3, 4], [0, 1, 2]]
    assert cov.first().coverage == 0.75
    vocab = mat.where(F.col("idx") > 0).select("symbol", "idx")
    ids = vb.encode_arrays(spark.createDataFrame([(1, ["the", "dog", "barks", "."])], "k long, w array<string>"), "w", vocab,
                           "ids", unk_idx=0, keys="k")
    assert ids.first().ids == [1, 2, 0, 3]
    dec = vb.decode_arrays(ids, "ids", vocab, "<UNK>", "s", keys="k")
    assert dec.first().s == ["the", "dog", "<UNK>", "."]


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    from wordlake.operators.ordering import global_index
    rows = global_index(df.repartition(13), [F.asc("k")], "i").collect()
    assert sorted((r.i, r.k) for r in rows) == [(i, i) for i in range(5000)]


def test_split_and_folds_invariants(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = ds.hash_split(df, "k", 1, 0.8)
    assert s.count() == 2000 and s.where("split = 'train'").count() + s.where("split = 'test'").count() == 2000
    folds = ds.stratified_folds(df, "y", "k", 5, 3).groupBy("y", "fold").count().collect()
    by_class = {}
    for r in folds:
        by_class.setdefault(r.y, []).append(r["count"])
    for sizes in by_class.values():
        assert max(sizes) - min(sizes) <= 1
    u = ds.undersample(df, "y", "k", 5).groupBy("y").count().collect()
    assert len({r["count"] for r in u}) == 1


def test_w10_num_skips_invariants(spark):
    df = spark.createDataFrame([(0, list("abcdefgh"))], "d long, w array<string>")
    rows = df.select(F.explode(ds.num_skips_contexts("w", 2, 2, F.col("d"), 1)).alias("p")).select("p.*").collect()
    per_pos = {}
    for r in rows:
        per_pos.setdefault(r.pos, []).append(r.offset)
        assert 1 <= abs(r.offset) <= 2
    assert all(len(v) == 2 and len(set(v)) == 2 for v in per_pos.values())


def test_nmf_error_decreases(spark):
    from wordlake.operators import topics as tp
    rnd = random.Random(3)
    trip = [(d, t, float(rnd.randint(1, 5))) for d, t in itertools.product(range(12), range(9)) if rnd.random() < 0.5]
    v = spark.createDataFrame(trip, "doc long, term string, v double").withColumn("term", F.concat(F.lit("t"), "term"))
    errs = []
    for it in (1, 4):
        W, H = tp.nmf(v, "doc", "term", "v", k=3, iterations=it, seed=1)
        errs.append(tp.reconstruction_error(v, W, H, "doc", "term", "v", 3))
    assert errs[1] <= errs[0] + 1e-9
    shares = tp.doc_topic_shares(W).select(F.aggregate("share", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)


def test_empty_texts_keep_their_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k long, w array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, idx long")
    enc = vb.encode_arrays(df, "w", vocab, "ids", unk_idx=0, keys="k")
    assert {r.k: r.ids for r in enc.collect()} == {1: [1, 2], 2: [], 3: []}
    dec = vb.decode_arrays(enc.select("k", "ids"), "ids", vocab, "?", "sym", keys="k")
    assert {r.k: r.sym for r in dec.collect()} == {1: ["a", "b"], 2: [], 3: []}


def test_shares_of_documents_without_terms(spark):
    W = spark.createDataFrame([(1, [1.0, 3.0])], "doc long, w array<double>")
    docs = spark.createDataFrame([(1,), (2,)], "doc long")
    assert {r.doc: r.share for r in tp.doc_topic_shares(tp.with_all_docs(W, docs, 2)).collect()} == {1: [0.25, 0.75], 2: [0.0, 0.0]}


def test_svd_of_all_words(spark, tmp_path):
    """More words than the 5000 that once were kept; the spectrum and lengths of numpy's dense SVD."""
    from wordlake.plans.model_queries import e11_svd_cooccurrence

    rnd = np.random.default_rng(3)
    name = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(4))
    docs = [(i, " ".join(name(int(x)) for x in (rnd.pareto(0.6, 30) * 5).astype(int) % 9000)) for i in range(400)] + [(400, "alone")]
    docs += [(401 + i, f"{name(9000 + 2 * i)} {name(9001 + 2 * i)}") for i in range(2600)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = e11_svd_cooccurrence(spark, str(tmp_path)).collect()
    split = [t.split() for _, t in docs]
    words = sorted({w for t in split for w in t})
    assert len(words) > 5000 and sorted(r.row_word for r in rows) == words and {r.k for r in rows} == {10}
    cells = co.two_sided(spark.createDataFrame([(t,) for t in split], "w array<string>"), "w", 5).collect()
    seen = sorted({c.row_word for c in cells})
    at = {w: i for i, w in enumerate(seen)}
    dense = np.zeros((len(seen), len(seen)))
    for c in cells:
        dense[at[c.row_word], at[c.col_word]] += c.weight
    value, vec = np.linalg.eigh(dense)
    top = np.argsort(-np.abs(value))[:10]
    assert [x.singular_value for x in rows[0].spectrum] == pytest.approx(np.abs(value[top]).tolist(), rel=1e-4)
    length = np.sqrt(((vec[:, top] * value[top]) ** 2).sum(1))
    norm = {r.row_word: r.norm for r in rows}
    assert norm["alone"] == 0 and max(abs(norm[w] - x) for w, x in zip(seen, length)) < 1e-2 * length.max()


def test_svd_of_any_matrix_moves_no_cells(spark):
    """A matrix that is not symmetric against numpy; after packing, a product's plan exchanges dense rows only."""
    from wordlake.operators import sparse as sp

    rnd = np.random.default_rng(5)
    dense = np.where(rnd.random((40, 40)) < 0.2, rnd.integers(1, 300, (40, 40)) * np.where(rnd.random((40, 40)) < 0.1, -0.5, 1), 0)
    cells = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    m = spark.createDataFrame(cells, "r int, c int, w double").repartition(3)
    s, rows = ve.sparse_svd(m, "r", "c", "w", 3, 40, tasks=2)
    u, value, _ = np.linalg.svd(dense)
    assert s == pytest.approx(value[:3].tolist(), rel=1e-6)
    got = {r.row: r.vec for r in rows.collect()}
    for i in range(40):
        assert np.linalg.norm(got.get(i, [0.0])) == pytest.approx(np.linalg.norm(u[i, :3] * value[:3]), abs=1e-3 * value[0])
    packed = sp.packed(m, 8, 2)
    assert sum(len(r.at) // 2 for r in packed.collect()) == len(cells)
    plan = sp.with_dense(packed, sp.started(spark, 4, 8, 40), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("InMemoryTableScan")]  # from the join down to the persisted cells
    packed.unpersist()

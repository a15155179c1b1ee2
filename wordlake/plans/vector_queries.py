"""Registered vector queries.

Word vectors: the documents' frequency vocabulary rank i is paired with
``embeddings.vec_id`` i (the fixture's "vec_id as word"), so every vector
query reads the given tables and grows with them. Query vectors for
nearest-neighbour search are the per-label centroids of the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import text as tx
from wordlake.operators import vectors as ve
from wordlake.operators import vocab as vb
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query

R6 = 6
DIM = 64


def _doc_vocab(t):
    words = t.documents.select("doc_id", tx.letters_only_words("text").alias("w"))
    return vb.frequency_vocabulary(vb.token_table(words, "w", "doc_id"))


def _word_vectors(t):
    """(word, vec) pairing vocabulary rank with vec_id."""
    e = t.embeddings.select(F.col("vec_id").alias("idx"), ve.as_double_vec("embedding").alias("vec"))
    return _doc_vocab(t).join(e, "idx").select(F.col("symbol").alias("word"), "vec")


def _unit_embeddings(t):
    e = t.embeddings.select("vec_id", "label", ve.as_double_vec("embedding").alias("vec"))
    return ve.normalize(e)


_DOC_W = f"(SELECT doc_id, {q.letters_only_words('text')} AS w FROM documents)"
_CONV_W = f"(SELECT conv_id, turn, {q.letters_only_words('text')} AS w FROM conversations)"
_VOCAB_SQL = f"""(SELECT token AS symbol, row_number() OVER (ORDER BY count(*) DESC, token DESC) - 1 AS idx
  FROM (SELECT unnest(w) AS token FROM {_DOC_W}) GROUP BY token)"""
_WV_SQL = f"""(SELECT v.symbol AS word, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM {_VOCAB_SQL} v JOIN embeddings e ON v.idx = e.vec_id)"""


def _sum_sql(v: str) -> str:
    return f"list_sum({v})"


def _norm_sql(v: str) -> str:
    return (f"list_transform({v}, lambda x: CASE WHEN sqrt(list_sum(list_transform({v}, lambda y: y * y))) = 0 "
            f"THEN 0.0 ELSE x / sqrt(list_sum(list_transform({v}, lambda y: y * y))) END)")


def _dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


_UNIT_SQL = f"""(SELECT vec_id, label, {_norm_sql('v')} AS vec
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""
_CENTROIDS_SQL = f"""(SELECT label, {_norm_sql('m')} AS vec FROM (
  SELECT label, list(a ORDER BY d) AS m FROM (
    SELECT label, d, avg(x) AS a FROM (SELECT label, unnest(generate_series(1, len(vec))) AS d, unnest(vec) AS x
      FROM {_UNIT_SQL}) GROUP BY label, d) GROUP BY label))"""


@query("e01_aligned_matrix", f"""WITH cv AS (SELECT token AS symbol,
    row_number() OVER (ORDER BY count(*) DESC, token DESC) AS idx
    FROM (SELECT unnest(w) AS token FROM {_CONV_W}) GROUP BY token),
m AS (SELECT cv.idx, cv.symbol, CAST(wv.word IS NOT NULL AS INTEGER) AS hit,
    round({_sum_sql('coalesce(wv.vec, repeat([0.0], 64))')}, 6) AS vec_sum
  FROM cv LEFT JOIN {_WV_SQL} wv ON cv.symbol = wv.word)
SELECT * FROM m UNION ALL SELECT 0 AS idx, NULL AS symbol, 0 AS hit, 0.0 AS vec_sum""")
def e01_aligned_matrix(spark, d):
    """Vectors aligned to the conversations vocabulary (index from 1),
    zeros for unknown words, row 0 = zeros."""
    t = Tables(spark, d)
    cw = t.conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    cv = vb.frequency_vocabulary(vb.token_table(cw, "w", ["conv_id", "turn"]), start=1)
    m = ve.aligned_matrix(cv, _word_vectors(t), DIM)
    return m.select("idx", "symbol", "hit", F.round(ar.array_sum("vec"), R6).alias("vec_sum"))


_CONV_TOK_SQL = f"""(SELECT conv_id, turn, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM {_CONV_W})"""


@query("e02_compact_embedding", f"""WITH wv AS {_WV_SQL}, t AS {_CONV_TOK_SQL},
m AS (SELECT token AS symbol, row_number() OVER (ORDER BY min((conv_id, turn, pos))) AS idx
  FROM t WHERE token IN (SELECT word FROM wv) GROUP BY token)
SELECT m.idx, m.symbol, round({_sum_sql('wv.vec')}, 6) AS vec_sum FROM m JOIN wv ON m.symbol = wv.word
UNION ALL SELECT 0 AS idx, '<UNK>' AS symbol, 0.0 AS vec_sum""")
def e02_compact_embedding(spark, d):
    """Compact embedding of the conversations corpus (index by first
    appearance from 1, row 0 zeros)."""
    t = Tables(spark, d)
    cw = t.conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    toks = vb.token_table(cw, "w", ["conv_id", "turn"])
    mat, _ = ve.compact_embedding(toks, _word_vectors(t), ["conv_id", "turn", "pos"], DIM)
    return mat.select("idx", "symbol", F.round(ar.array_sum("vec"), R6).alias("vec_sum"))


@query("e02_coverage", f"""WITH wv AS {_WV_SQL}, t AS {_CONV_TOK_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE token IN (SELECT word FROM wv)) AS matched,
  round(CAST(count(*) FILTER (WHERE token IN (SELECT word FROM wv)) AS DOUBLE) / count(*), 6) AS coverage FROM t""")
def e02_coverage(spark, d):
    """Share of corpus tokens that have a vector."""
    t = Tables(spark, d)
    cw = t.conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    toks = vb.token_table(cw, "w", ["conv_id", "turn"])
    _, cov = ve.compact_embedding(toks, _word_vectors(t), ["conv_id", "turn", "pos"], DIM)
    return cov.select("total", "matched", F.round("coverage", R6).alias("coverage"))


@query("e03_special_vectors", f"""WITH a AS (SELECT word, vec FROM {_WV_SQL} UNION ALL
  SELECT * FROM (VALUES ('<UNK>', repeat([0.0], 64)), ('<PAD>', repeat([1.0], 64)), ('<GO>', repeat([-1.0], 64))) s(word, vec))
SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx, round({_sum_sql('vec')}, 6) AS vec_sum FROM a""")
def e03_special_vectors(spark, d):
    """Word vectors plus <UNK>/<PAD>/<GO> (0s, 1s, -1s), indexed by sorted word."""
    s = ve.with_special_vectors(_word_vectors(Tables(spark, d)), DIM)
    return s.select("word", "idx", F.round(ar.array_sum("vec"), R6).alias("vec_sum"))


@query("e05_normalize", f"""SELECT vec_id, generate_subscripts(vec, 1) - 1 AS dim, round(unnest(vec), 6) AS x
FROM {_UNIT_SQL}""")
def e05_normalize(spark, d):
    """E5: l2-normalized vectors, one row per (vector, dimension)."""
    u = _unit_embeddings(Tables(spark, d))
    return u.select("vec_id", F.posexplode("vec").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", R6).alias("x"))


def _nn_sql(score: str, order: str, k: int = 10) -> str:
    return f"""SELECT qid, key, round(score, 6) AS score, rank FROM (
  SELECT c.label AS qid, u.vec_id AS key, {score} AS score,
    row_number() OVER (PARTITION BY c.label ORDER BY round({score}, 9) {order}, u.vec_id) AS rank
  FROM {_UNIT_SQL} u, {_CENTROIDS_SQL} c) WHERE rank <= {k}"""


def _nn(spark, d, method):
    t = Tables(spark, d)
    u = _unit_embeddings(t)
    cents = ve.label_centroids(u, "label").withColumnRenamed("label", "qid")
    r = ve.nearest(cents, u.select(F.col("vec_id").alias("word"), "vec"), 10, method)
    return r.select(F.col("qid").cast("int").alias("qid"), "key", F.round("score", R6).alias("score"), "rank")


@query("e06_nearest_cos", _nn_sql(_dot_sql("c.vec", "u.vec"), "DESC"))
def e06_nearest_cos(spark, d):
    """10 nearest vectors by cosine to each label centroid."""
    return _nn(spark, d, "cos")


@query("e07_nearest", _nn_sql("list_sum(list_transform(list_zip(c.vec, u.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
                              "ASC"))
def e07_nearest(spark, d):
    """10 nearest vectors by squared Euclidean distance to each label centroid."""
    return _nn(spark, d, "euclid")


def _text_vec_sql(src: str, key: str) -> str:
    return f"""(SELECT {key}, {_norm_sql('m')} AS vec FROM (
  SELECT {key}, list(a ORDER BY dd) AS m FROM (
    SELECT {key}, dd, avg(x) AS a FROM (
      SELECT {key}, unnest(generate_series(1, 64)) AS dd, unnest(coalesce(wv.vec, repeat([0.0], 64))) AS x
      FROM (SELECT {key}, unnest(w) AS token FROM {src}) t LEFT JOIN {_WV_SQL} wv ON t.token = wv.word)
    GROUP BY {key}, dd) GROUP BY {key}))"""


_BENCH_W = f"(SELECT item_id, {q.letters_only_words('text')} AS w FROM benchmark)"


@query("e08_nearest_texts", f"""WITH dv AS {_text_vec_sql(_DOC_W, 'doc_id')}, bv AS {_text_vec_sql(_BENCH_W, 'item_id')}
SELECT qid, key, round(score, 6) AS score, rank FROM (
  SELECT bv.item_id AS qid, dv.doc_id AS key, {_dot_sql('bv.vec', 'dv.vec')} AS score,
    row_number() OVER (PARTITION BY bv.item_id ORDER BY round({_dot_sql('bv.vec', 'dv.vec')}, 9) DESC, dv.doc_id) AS rank
  FROM dv, bv) WHERE rank <= 5""")
def e08_nearest_texts(spark, d):
    """E8 + E9: 5 documents nearest (cosine of mean word vectors) to each benchmark passage."""
    t = Tables(spark, d)
    wv = _word_vectors(t)
    dt = vb.token_table(t.documents.select("doc_id", tx.letters_only_words("text").alias("w")), "w", "doc_id")
    bt = vb.token_table(t.benchmark.select("item_id", tx.letters_only_words("text").alias("w")), "w", "item_id")
    dv = ve.text_vectors(dt, wv, "doc_id", DIM).withColumnRenamed("doc_id", "word")
    bv = ve.text_vectors(bt, wv, "item_id", DIM).withColumnRenamed("item_id", "qid")
    r = ve.nearest(bv, dv, 5, "cos")
    return r.select("qid", "key", F.round("score", R6).alias("score"), "rank")


@query("e09_text_vectors", f"""SELECT doc_id, generate_subscripts(vec, 1) - 1 AS dim, round(unnest(vec), 6) AS x
FROM {_text_vec_sql(_DOC_W, 'doc_id')}""")
def e09_text_vectors(spark, d):
    """Document vectors = normalized mean of word vectors (zeros for misses)."""
    t = Tables(spark, d)
    dt = vb.token_table(t.documents.select("doc_id", tx.letters_only_words("text").alias("w")), "w", "doc_id")
    dv = ve.text_vectors(dt, _word_vectors(t), "doc_id", DIM)
    return dv.select("doc_id", F.posexplode("vec").alias("dim", "x")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", R6).alias("x"))


@query("e09_weighted_vectors", f"""WITH tk AS (SELECT doc_id, unnest(w) AS token FROM {_DOC_W}),
p AS (SELECT token, count(*)::DOUBLE / (SELECT count(*) FROM tk) AS p FROM tk GROUP BY token),
n AS (SELECT doc_id, token, count(*) * 1e-3 / (1e-3 + any_value(p.p)) AS w FROM tk JOIN p USING (token) GROUP BY doc_id, token),
m AS (SELECT doc_id, dd, sum(w * x) / sum(w) AS a FROM (SELECT doc_id, w, unnest(generate_series(1, 64)) AS dd, unnest(coalesce(wv.vec, repeat([0.0], 64))) AS x
  FROM n LEFT JOIN {_WV_SQL} wv ON n.token = wv.word) GROUP BY doc_id, dd)
SELECT doc_id, generate_subscripts(vec, 1) - 1 AS dim, round(unnest(vec), 6) AS x FROM (
  SELECT doc_id, {_norm_sql('v')} AS vec FROM (SELECT doc_id, list(a ORDER BY dd) AS v FROM m GROUP BY doc_id))""")
def e09_weighted_vectors(spark, d):
    """Document vectors with frequency weights 0.001 / (0.001 + share)."""
    t = Tables(spark, d)
    dt = vb.token_table(t.documents.select("doc_id", tx.letters_only_words("text").alias("w")), "w", "doc_id")
    dv = ve.weighted_text_vectors(dt, _word_vectors(t), "doc_id", DIM, common=0)
    return dv.select("doc_id", F.posexplode("vec").alias("dim", "x")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", R6).alias("x"))


@query("e09_common_removed")
def e09_common_removed(spark, d):
    """The weighted document vectors without their first common direction."""
    t = Tables(spark, d)
    dt = vb.token_table(t.documents.select("doc_id", tx.letters_only_words("text").alias("w")), "w", "doc_id")
    return ve.weighted_text_vectors(dt, _word_vectors(t), "doc_id", DIM).select("doc_id", F.transform("vec", lambda x: F.round(x, R6)).alias("vec"))


@query("e10_similarity", f"""WITH v AS {_VOCAB_SQL}, wv AS {_WV_SQL}
SELECT round({_dot_sql('a.vec', 'b.vec')}, 6) AS similarity FROM wv a, wv b
WHERE a.word = (SELECT symbol FROM v WHERE idx = 0) AND b.word = (SELECT symbol FROM v WHERE idx = 1)""")
def e10_similarity(spark, d):
    """Dot-product similarity of the two most frequent document words."""
    t = Tables(spark, d)
    voc = _doc_vocab(t)
    wv = _word_vectors(t)
    a = voc.where(F.col("idx") == 0).select(F.col("symbol").alias("word")).join(wv, "word").select(F.col("vec").alias("a"))
    b = voc.where(F.col("idx") == 1).select(F.col("symbol").alias("word")).join(wv, "word").select(F.col("vec").alias("b"))
    return a.crossJoin(b).select(F.round(ar.dot("a", "b"), R6).alias("similarity"))

"""Registered dataset-assembly and evaluation queries (D, W2, W3, W10, O7, O8, K).

The seeded hash is md5-based (first 32 bits of md5(key || ':' || seed)), so
DuckDB reproduces every random choice exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import math as mt
from wordlake.functions import text as tx
from wordlake.operators import dataset as ds
from wordlake.operators import evaluate as ev
from wordlake.operators import relational as rl
from wordlake.operators import stats as st
from wordlake.operators import vocab as vb
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query

R6 = 6


def _h(key: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT)"


@query("d01_hash_split", f"""SELECT doc_id, CASE WHEN {_h('doc_id', 42)} % 1000 < 800 THEN 'train' ELSE 'test' END AS split
FROM documents""")
def d01_hash_split(spark, d):
    """Seeded 80/20 split; the test part is the exact complement."""
    return ds.hash_split(Tables(spark, d).documents.select("doc_id"), "doc_id", 42, 0.8)


@query("d03_ordered_split", """SELECT doc_id, CASE WHEN rn < n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)""")
def d03_ordered_split(spark, d):
    """D3: ordered split, first 80 % train (no shuffle)."""
    return ds.ordered_split(Tables(spark, d).documents.select("doc_id"), [F.asc("doc_id")], 0.2)


def _undersample_sql(order: str) -> str:
    return f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {order}) - 1 AS rk
  FROM labels), m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM labels GROUP BY quality))
SELECT doc_id, quality FROM r, m WHERE rk < m"""


@query("d04_undersample", _undersample_sql(f"{_h('doc_id', 7)}, doc_id"))
def d04_undersample(spark, d):
    """Exact under-sampling, each class cut to the smallest class (seeded)."""
    return ds.undersample(Tables(spark, d).labels.select("doc_id", "quality"), "quality", "doc_id", 7)


@query("d05_first_negatives", _undersample_sql("doc_id"))
def d05_first_negatives(spark, d):
    """Under-sampling keeping the first rows by key."""
    return ds.undersample(Tables(spark, d).labels.select("doc_id", "quality"), "quality", "doc_id")


@query("d06_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id', 11)}, doc_id) - 1 AS rank FROM documents")
def d06_shuffle(spark, d):
    """Seeded permutation of the documents."""
    return ds.shuffle_rank(Tables(spark, d).documents.select("doc_id"), "doc_id", 11)


_FOLDS_SQL = f"""(SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality
  ORDER BY {_h('doc_id', 13)}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels)"""


@query("d07_stratified_folds", f"SELECT * FROM {_FOLDS_SQL}")
def d07_stratified_folds(spark, d):
    """5 class-stratified folds (seeded)."""
    return ds.stratified_folds(Tables(spark, d).labels.select("doc_id", "quality"), "quality", "doc_id", 5, 13)


@query("d08_fold_metrics", f"""WITH f AS {_FOLDS_SQL},
p AS (SELECT f.fold, f.quality AS y, CAST(d.n_chars >= 2000 AS INTEGER) AS p FROM f JOIN documents d ON f.doc_id = d.doc_id),
c AS (SELECT fold, sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn FROM p GROUP BY fold),
m AS (SELECT fold, CASE WHEN tp + fp = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
  CASE WHEN 2 * tp + fp + fn = 0 THEN NULL ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c)
SELECT fold, round(precision, 6) AS precision, round(f1, 6) AS f1,
  round(avg(precision) OVER (), 6) AS mean_precision, round(avg(f1) OVER (), 6) AS mean_f1 FROM m""")
def d08_fold_metrics(spark, d):
    """Precision and F1 of the length rule per fold, and their means."""
    t = Tables(spark, d)
    f = ds.stratified_folds(t.labels.select("doc_id", "quality"), "quality", "doc_id", 5, 13)
    p = f.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "fold", F.col("quality").alias("y"), rl.threshold_label("n_chars", 2000).alias("p"))
    c = ev.confusion(p, "y", "p", by=["fold"])
    means = c.agg(F.avg("precision").alias("mean_precision"), F.avg("f1").alias("mean_f1"))
    return c.crossJoin(means).select("fold", *[F.round(x, R6).alias(x) for x in
                                               ("precision", "f1", "mean_precision", "mean_f1")])


@query("d09_prefix_cut", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3000")
def d09_prefix_cut(spark, d):
    """The first 3000 rows by key (exact, distributed order numbers)."""
    return ds.prefix_rows(Tables(spark, d).orders.select("o_orderkey"), [F.asc("o_orderkey")], 3000)


@query("d10_class_weights", """WITH c AS (SELECT quality, count(*) AS c FROM labels GROUP BY quality)
SELECT doc_id, l.quality, round(CAST((SELECT sum(c) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * c.c), 6) AS weight
FROM labels l JOIN c ON l.quality = c.quality""")
def d10_class_weights(spark, d):
    """Balanced sample weight per class."""
    w = ds.balanced_weights(Tables(spark, d).labels.select("doc_id", "quality"), "quality")
    return w.select("doc_id", "quality", F.round("weight", R6).alias("weight"))


_CONV_W = f"(SELECT conv_id, turn, {q.letters_only_words('text')} AS w FROM conversations)"


@query("w02_random_window", f"""SELECT conv_id, turn, st AS start, array_to_string(w[st + 1:st + 3], ' ') AS window FROM (
  SELECT conv_id, turn, w, CAST({_h("conv_id || '|' || turn", 3)} % (len(w) - 2) AS INTEGER) AS st
  FROM {_CONV_W} WHERE len(w) >= 3)""")
def w02_random_window(spark, d):
    """One seeded random 3-token window per conversation turn."""
    c = Tables(spark, d).conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    key = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    r = c.select("conv_id", "turn", ds.random_window("w", 3, key, 3).alias("r")).where(F.col("r").isNotNull())
    return r.select("conv_id", "turn", F.col("r.start").alias("start"), F.array_join("r.window", " ").alias("window"))


@query("w03_window_split", f"""SELECT conv_id, turn, i - 1 AS start,
  CASE WHEN {_h("conv_id || '|' || turn || '|' || (i - 1)", 5)} % 1000 < 800 THEN 'train' ELSE 'test' END AS split
FROM (SELECT conv_id, turn, unnest(generate_series(1, len(w) - 2)) AS i FROM {_CONV_W} WHERE len(w) >= 3)""")
def w03_window_split(spark, d):
    """Sliding windows (size 3) split 80/20 by a seeded hash of their position."""
    from wordlake.operators import sequences as sq
    c = Tables(spark, d).conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    r = sq.window_rows(c, "w", 3, ["conv_id", "turn"]).select("conv_id", "turn", F.col("start").cast("long").alias("start"))
    return ds.hash_split(r, ["conv_id", "turn", "start"], 5, 0.8)


@query("w10_num_skips")
def w10_num_skips(spark, d):
    """For every position, 2 distinct seeded contexts within +-2 (rows-only;
    invariants checked in tests)."""
    c = Tables(spark, d).conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    key = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    p = c.select("conv_id", "turn", F.explode(ds.num_skips_contexts("w", 2, 2, key, 9)).alias("p"))
    return p.select("conv_id", "turn", "p.pos", "p.offset", "p.word", "p.context")


@query("o07_sample", f"SELECT doc_id FROM documents ORDER BY {_h('doc_id', 3)}, doc_id LIMIT 100")
def o07_sample(spark, d):
    """A seeded sample of 100 documents."""
    return ds.sample_rows(Tables(spark, d).documents.select("doc_id"), "doc_id", 100, 3)


@query("o08_random_frequent", f"""WITH f AS (SELECT token AS symbol, count(*) AS freq FROM
  (SELECT unnest({q.letters_only_words('text')}) AS token FROM documents) GROUP BY token
  ORDER BY freq DESC, symbol DESC LIMIT 100)
SELECT symbol FROM f ORDER BY {_h('symbol', 5)}, symbol LIMIT 16""")
def o08_random_frequent(spark, d):
    """16 seeded picks among the 100 most frequent document words."""
    w = Tables(spark, d).documents.select("doc_id", tx.letters_only_words("text").alias("w"))
    top = rl.top_n(vb.frequencies(vb.token_table(w, "w", "doc_id")), 100, [F.desc("freq"), F.desc("symbol")])
    return ds.sample_rows(top.select("symbol"), "symbol", 16, 5)


_RULE_SQL = """(SELECT l.quality AS y, CAST(d.n_chars >= 2000 AS INTEGER) AS p, d.lang, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
_CONF_SQL = """CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn"""
_RATES_SQL = """round(CASE WHEN tp + fp = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN NULL ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy"""


def _rounded(c):
    return c.select(*[F.round(x, R6).alias(x) if x in ("precision", "recall", "f1", "accuracy") else x
                      for x in c.columns])


@query("k01_precision_recall", f"""SELECT *, {_RATES_SQL} FROM (SELECT {_CONF_SQL} FROM {_RULE_SQL})""")
def k01_precision_recall(spark, d):
    """K1 / K4 / K7: confusion counts, precision, recall, F1 and accuracy of
    the rule 'n_chars >= 2000 -> quality 1'."""
    t = Tables(spark, d)
    p = t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("y"),
                                                    rl.threshold_label("n_chars", 2000).alias("p"))
    return _rounded(ev.confusion(p, "y", "p"))


@query("k02_validate_two_column", f"""WITH s AS (SELECT y, 1 / (1 + exp(-((n_chars - 2000) / 500.0))) AS s FROM {_RULE_SQL}),
a AS (SELECT y, CAST(CASE WHEN s > 1 - s THEN 1 ELSE 0 END AS INTEGER) AS p FROM s)
SELECT *, {_RATES_SQL} FROM (SELECT {_CONF_SQL} FROM a)""")
def k02_validate_two_column(spark, d):
    """K2: argmax of two-column truth (neg, pos) and prediction, then K1."""
    t = Tables(spark, d)
    j = t.labels.join(t.documents, "doc_id")
    s = mt.sigmoid((F.col("n_chars") - 2000) / 500.0)
    two = j.select(ar.two_column_label("quality").alias("truth"), F.array(1 - s, s).alias("pred"))
    yt, yp = ev.argmax_classes("truth", "pred")
    return _rounded(ev.confusion(two.select(yt.alias("y"), yp.alias("p")), "y", "p"))


_ECDF_SQL = """(SELECT event_id, (rank() OVER (ORDER BY value) - 1) / count(*) OVER () AS y,
  (rank() OVER (ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE)) - 1) / count(*) OVER () AS yhat FROM events)"""


@query("k03_regression_validate", f"""WITH e AS {_ECDF_SQL},
t AS (SELECT count(*) FILTER (WHERE value < 50) / count(*) AS thr FROM events),
a AS (SELECT CAST(y >= thr AS INTEGER) AS y, CAST(yhat >= thr AS INTEGER) AS p FROM e, t)
SELECT *, {_RATES_SQL} FROM (SELECT {_CONF_SQL} FROM a)""")
def k03_regression_validate(spark, d):
    """K3: ECDF-scaled regression target and prediction classified at the
    ECDF of the threshold 50 (prediction: the ECDF of props.k)."""
    e = Tables(spark, d).events.select("event_id", "value",
                                       F.get_json_object("props", "$.k").cast("double").alias("k"))
    y = st.ecdf(e, "value", "y")
    yh = st.ecdf(y, "k", "yhat")
    thr = e.agg(F.try_divide(F.sum((F.col("value") < 50).cast("long")).cast("double"),
                             F.count(F.lit(1))).alias("thr"))
    a = yh.crossJoin(F.broadcast(thr)).select((F.col("y") >= F.col("thr")).cast("int").alias("y"),
                                              (F.col("yhat") >= F.col("thr")).cast("int").alias("p"))
    return _rounded(ev.confusion(a, "y", "p"))


@query("k04_accuracy_by_lang", f"""SELECT lang, round(avg(CAST(p = y AS DOUBLE)), 6) AS accuracy, count(*) AS n
FROM {_RULE_SQL} GROUP BY lang""")
def k04_accuracy_by_lang(spark, d):
    """K4: accuracy of the length rule per language."""
    t = Tables(spark, d)
    p = t.labels.join(t.documents, "doc_id").select("lang", (rl.threshold_label("n_chars", 2000) ==
                                                             F.col("quality")).cast("double").alias("ok"))
    return p.groupBy("lang").agg(F.round(F.avg("ok"), R6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("k05_weighted_auc", """WITH s AS (SELECT CAST(embedding[1] AS DOUBLE) AS s, CAST(label >= 5 AS INTEGER) AS y,
  CAST(CASE WHEN label = 0 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS w FROM embeddings),
per AS (SELECT s, sum(CASE WHEN y = 1 THEN w ELSE 0.0 END) AS wp, sum(CASE WHEN y = 0 THEN w ELSE 0.0 END) AS wn
  FROM s GROUP BY s),
b AS (SELECT wp, wn, coalesce(sum(wn) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS nb FROM per)
SELECT round(sum(wp * (nb + wn / 2)) / (sum(wp) * sum(wn)), 6) AS auc, sum(wp) AS w_pos, sum(wn) AS w_neg FROM b""")
def k05_weighted_auc(spark, d):
    """K5: exact weighted AUC of the first coordinate for 'label >= 5',
    label-0 vectors masked out (weight 0)."""
    e = Tables(spark, d).embeddings
    s = e.select(F.col("embedding")[0].alias("s"), (F.col("label") >= 5).cast("int").alias("y"),
                 F.when(F.col("label") == 0, 0.0).otherwise(1.0).alias("w"))
    a = ev.weighted_auc(s, "s", "y", "w")
    return a.select(F.round("auc", R6).alias("auc"), "w_pos", "w_neg")


@query("k06_masked_bce", """WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT vec_id, generate_subscripts(v, 1) AS i, v, label FROM x),
r AS (SELECT vec_id, CASE WHEN v[i] > 0 THEN 1.0 ELSE 0.0 END AS y,
  least(greatest(1 / (1 + exp(-8 * v[(i % len(v)) + 1])), 1e-7), 1 - 1e-7) AS p,
  CASE WHEN i - 1 < 6 * (label + 1) THEN 1.0 ELSE 0.0 END AS m FROM e),
per AS (SELECT vec_id, sum(-(y * ln(p) + (1 - y) * ln(1 - p)) * m) / sum(m) AS l FROM r GROUP BY vec_id)
SELECT round(avg(l), 6) AS masked_bce, count(l) AS n_examples FROM per""")
def k06_masked_bce(spark, d):
    """K6: masked binary cross-entropy (truth: coordinate > 0; prediction:
    sigmoid of the next coordinate x 8; mask: the first 6 (label + 1) positions)."""
    e = Tables(spark, d).embeddings.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = F.size("v")
    y = F.transform("v", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    p = F.transform("v", lambda x, i: mt.sigmoid(F.element_at("v", (i + 1) % n + 1) * 8))
    m = F.transform("v", lambda x, i: F.when(i < (F.col("label") + 1) * 6, 1.0).otherwise(0.0))
    r = ev.masked_bce(e.select(y.alias("y"), p.alias("p"), m.alias("m")), "y", "p", "m")
    return r.select(F.round("masked_bce", R6).alias("masked_bce"), "n_examples")


@query("k08_reconstruction_error", """SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding[1:32] AS DOUBLE[]),
  CAST(embedding[33:64] AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 32, 6) AS err FROM embeddings""")
def k08_reconstruction_error(spark, d):
    """K8: mean squared difference between the two halves of each vector."""
    e = Tables(spark, d).embeddings
    return e.select("vec_id", F.round(ev.reconstruction_error(F.slice("embedding", 1, 32),
                                                            F.slice("embedding", 33, 32)), R6).alias("err"))

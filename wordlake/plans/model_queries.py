"""Registered iterative / model queries.

Iterative algorithms and fitted models have no SQL twin: these are
rows-only checks in the driver; tests cover their invariants (NMF error
decreases, shares sum to 1, SVD spectrum, prediction ranges).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import math as mt
from wordlake.functions import text as tx
from wordlake.operators import blocked_pairs as bp
from wordlake.operators import boosting as bo
from wordlake.operators import dataset as ds
from wordlake.operators import evaluate as ev
from wordlake.operators import models as md
from wordlake.operators import topics as tp
from wordlake.operators import vectors as ve
from wordlake.operators import vocab as vb
from wordlake.operators import wordvectors as wv
from wordlake.plans.registry import Tables, query

K_TOPICS = 20
ITERATIONS = 20


def _bow_min_df(t):
    w = t.documents.select("doc_id", tx.remove_stop_words(tx.bow_words("text")).alias("w"))
    return vb.bag_of_words(w, "w", "doc_id", min_df=20)


_FITS: dict[tuple, tuple] = {}


def _nmf(spark, d, iterations=ITERATIONS):
    """One fit for all topic queries over the same files in one application; its tables lie in the checkpoint folder."""
    t = Tables(spark, d)
    key = (spark.sparkContext.applicationId, tuple(sorted(t.documents.inputFiles())), iterations)
    if key not in _FITS:
        _FITS[key] = tp.nmf(_bow_min_df(t), "doc_id", "term", "tf", K_TOPICS, iterations, seed=0)
    W, H = _FITS[key]
    return tp.with_all_docs(W, t.documents.select(F.col("doc_id").alias("doc")), K_TOPICS), H


@query("g01_topics")
def g01_topics(spark, d):
    """G1 + G2: NMF (k = 20, 20 multiplicative-update iterations) of the
    document-term matrix (stop words removed, min_df 20); top 20 terms per topic."""
    _, H = _nmf(spark, d)
    return tp.top_terms(H, 20).select("topic", "rank", "term", "weight")


@query("g03_doc_topics")
def g03_doc_topics(spark, d):
    """Document-topic shares (rows of W, l1-normalized)."""
    W, _ = _nmf(spark, d)
    return tp.doc_topic_shares(W).select(F.col("doc").alias("doc_id"), "share")


@query("g04_page_topics")
def g04_page_topics(spark, d):
    """The 10 largest topics of every document."""
    W, _ = _nmf(spark, d)
    return tp.top_topics(tp.doc_topic_shares(W), 10).select(F.col("doc").alias("doc_id"), "topics")


@query("g05_closest_pages")
def g05_closest_pages(spark, d):
    """For the first document of each source, the 10 closest documents by
    L1 distance of topic shares (itself included)."""
    t = Tables(spark, d)
    W, _ = _nmf(spark, d)
    shares = tp.doc_topic_shares(W)
    queries = t.documents.groupBy("source").agg(F.min("doc_id").alias("doc"))
    return tp.closest_docs(shares, queries, 10).select(F.col("qid").alias("query_doc"), F.col("key").alias("doc_id"),
                                                      F.col("score").alias("l1"), "rank")


@query("e11_svd_cooccurrence")
def e11_svd_cooccurrence(spark, d):
    """Truncated SVD (k = 10) of the two-sided co-occurrence matrix of all
    document words; singular values and the length of every word's vector
    u * s (0 for a word that stands with no other)."""
    words = Tables(spark, d).documents.select(F.monotonically_increasing_id().alias("row"), tx.letters_only_words("text").alias("w"))
    coded, enc, size, _ = bp.numbered(words, "w", ["row"])
    s, scaled = ve.sparse_svd(None, "row_word", "col_word", "weight", 10, size, symmetric=True,
                              pieces=lambda blocks: bp.pieces(coded, "ids", 5, blocks, skip_equal=True, both_ways=True))
    sv = spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "component int, singular_value double")
    top = enc.select(F.col("symbol").alias("row_word"), F.col("idx").alias("row")).join(scaled, "row", "left")
    spectrum = sv.agg(F.sort_array(F.collect_list(F.struct("component", "singular_value"))).alias("spectrum"))
    return top.select("row_word", F.lit(len(s)).alias("k"), F.coalesce(ar.l2_norm("vec"), F.lit(0.0)).alias("norm")).crossJoin(spectrum)


@query("e12_svd_dense")
def e12_svd_dense(spark, d):
    """E12 + E13: dense SVD (k = 10) of the vector table; singular spectrum and
    every vector's 2-D coordinates on the first two right singular vectors."""
    e = Tables(spark, d).embeddings.select("vec_id", ve.as_double_vec("embedding").alias("vec"))
    s, v, _ = ve.svd(e, "vec", 10)
    coords = ve.project(e, "vec", v[:, :2])
    return coords.select("vec_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"),
                         F.lit(float(s[0])).alias("s1"), F.lit(float(s[1])).alias("s2"))


@query("e14_word2vec")
def e14_word2vec(spark, d):
    """Skip-gram word vectors (dim 30, min count 5) of all words."""
    t = Tables(spark, d)
    words = t.documents.select(tx.letters_only_words("text").alias("w"))
    return ve.train_word2vec(words, "w", 30, 5)[1]


@query("e14_sharded_vectors")
def e14_sharded_vectors(spark, d):
    """Skip-gram vectors (dim 32, window 5, min count 5, 2 epochs) by
    negative sampling, parameters sharded by word; every epoch's mean loss."""
    words = Tables(spark, d).documents.select("doc_id", tx.letters_only_words("text").alias("w"))
    vocab = vb.token_table(words, "w", "doc_id").groupBy(F.col("token").alias("symbol")).agg(F.count("*").alias("freq")).where("freq >= 5")
    vectors, losses = wv.skipgram_vectors(wv.pair_counts(words, "w", 5), vocab, 32, epochs=2)
    return vectors.select("word", "vec", F.array(*(F.lit(float(x)) for x in losses)).alias("losses"))


def _labelled_features(t):
    f = md.document_features(t.documents)
    return f.join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")


def _split(df, key):
    s = ds.hash_split(df, key, 42, 0.8)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


@query("m01_random_forest")
def m01_random_forest(spark, d):
    """M1 + M8: entropy random forest on document features -> quality; test
    predictions with P(1) and the class at 0.5."""
    train, test = _split(_labelled_features(Tables(spark, d)), "doc_id")
    _, pred = md.fit_predict(train, test, md.classifier("rf"), md.DOC_FEATURES, keep=["doc_id", "label"])
    return pred.withColumn("cls", md.to_class("p1"))


@query("m03_gbt_classifier")
def m03_gbt_classifier(spark, d):
    """M3: gradient-boosted trees classifier."""
    train, test = _split(_labelled_features(Tables(spark, d)), "doc_id")
    _, pred = md.fit_predict(train, test, md.classifier("gbt"), md.DOC_FEATURES, keep=["doc_id", "label"])
    return pred


@query("m07_mlp")
def m07_mlp(spark, d):
    """M7: fully connected classifier (7 -> 8 -> 2)."""
    train, test = _split(_labelled_features(Tables(spark, d)), "doc_id")
    est = md.classifier("mlp", layers=[len(md.DOC_FEATURES), 8, 2])
    _, pred = md.fit_predict(train, test, est, md.DOC_FEATURES, keep=["doc_id", "label"])
    return pred


@query("k09_model_metrics")
def k09_model_metrics(spark, d):
    """K1 / K4 on model output: confusion, precision, recall of the forest."""
    return ev.confusion(m01_random_forest(spark, d), "label", "cls")


@query("o05_importances")
def o05_importances(spark, d):
    """Forest feature importances with names, descending."""
    train, test = _split(_labelled_features(Tables(spark, d)), "doc_id")
    model, _ = md.fit_predict(train, test, md.classifier("rf"), md.DOC_FEATURES, keep=["doc_id"])
    return md.importances(model, md.DOC_FEATURES)


EVENT_FEATURES = ["dayofweek", "hour", "month", "day", "user_id_d", "k"]


def _event_features(t):
    e = t.events
    cal = mt.calendar_features("ts")
    return e.select("event_id", F.col("value").alias("label"), *[c.cast("double").alias(n) for n, c in cal.items()],
                    F.col("user_id").cast("double").alias("user_id_d"),
                    F.get_json_object("props", "$.k").cast("double").alias("k")).fillna(0.0)


@query("m02_rf_regressor")
def m02_rf_regressor(spark, d):
    """M2: random-forest regression of event value on time and user features."""
    train, test = _split(_event_features(Tables(spark, d)), "event_id")
    _, pred = md.fit_predict(train, test, md.regressor("rf"), EVENT_FEATURES, keep=["event_id", "label"])
    return pred


@query("m04_gbt_regressor")
def m04_gbt_regressor(spark, d):
    """M4: boosted regression trees with subsampling 0.8."""
    train, test = _split(_event_features(Tables(spark, d)), "event_id")
    _, pred = md.fit_predict(train, test, md.regressor("gbt"), EVENT_FEATURES, keep=["event_id", "label"])
    return pred


@query("m05_lasso")
def m05_lasso(spark, d):
    """M5: lasso (L1-penalized linear regression)."""
    train, test = _split(_event_features(Tables(spark, d)), "event_id")
    _, pred = md.fit_predict(train, test, md.regressor("lasso"), EVENT_FEATURES, keep=["event_id", "label"])
    return pred


@query("m06_stacking")
def m06_stacking(spark, d):
    """Out-of-fold forest and boosting probabilities side by side,
    then a logistic-regression meta model."""
    f = _labelled_features(Tables(spark, d))
    folded = ds.stratified_folds(f, "label", "doc_id", 3, 13)
    base = {"p_rf": lambda: md.classifier("rf"), "p_gbt": lambda: md.classifier("gbt")}
    return md.stack(folded, "fold", 3, base, md.DOC_FEATURES, "doc_id", "label")


def _event_kinds(t):
    e = t.events.where(F.col("value").isNotNull())
    return e.select("event_id", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("dow"), (F.col("user_id") % 10).alias("user_mod"),
                    (F.xxhash64("event_type") % 100).alias("kind"), "value", (F.pmod(F.xxhash64(F.col("event_id"), F.lit(3)), F.lit(5)) == 0).alias("held_out"))


@query("m04_second_order_trees")
def m04_second_order_trees(spark, d):
    """M4: boosted trees by second-order gain on histograms (log loss), fitted
    on four fifths of the labelled documents; probabilities of the rest."""
    f = _labelled_features(Tables(spark, d)).withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0)
    model = bo.fit_trees(f.where(~F.col("held_out")), md.DOC_FEATURES, "label", "logistic", rounds=10)
    return bo.predict(f.where("held_out"), md.DOC_FEATURES, model, ["doc_id", "label"], "probability")


@query("m05_linear_booster")
def m05_linear_booster(spark, d):
    """M5: linear booster by block coordinate Newton steps, fitted on four
    fifths of the labelled documents; probabilities of the rest."""
    f = _labelled_features(Tables(spark, d)).withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0)
    model = bo.fit_linear(f.where(~F.col("held_out")), md.DOC_FEATURES, "label", "logistic", rounds=6)
    return bo.predict(f.where("held_out"), md.DOC_FEATURES, model, ["doc_id", "label"], "probability")


@query("k03_fitted_regression")
def k03_fitted_regression(spark, d):
    """K3: a regression checked as a classification: event values predicted by
    boosted trees, truth and prediction classified at the mean of the training values."""
    cols = ["hour", "dow", "user_mod", "kind"]
    e = _event_kinds(Tables(spark, d))
    model = bo.fit_trees(e.where(~F.col("held_out")), cols, "value", "squared", rounds=5)
    p = bo.predict(e.where("held_out"), cols, model, ["event_id", "value"])
    p = p.select((F.col("value") >= model.base).cast("int").alias("truth"), (F.col("prediction") >= model.base).cast("int").alias("pred"))
    return ev.confusion(p, "truth", "pred")

"""Classical distributed models with pyspark.ml.

Features stay in DataFrames until the ML border; VectorAssembler builds the
feature vector; the fitted models score in parallel. Stacking (M6) uses
out-of-fold base predictions (the reference used in-sample ones).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.functions import text as tx
from wordlake.session import cut_lineage

DOC_FEATURES = ["n_chars", "n_words", "n_sentences", "distinct_share", "mean_word_len", "upper_share", "is_en"]


def document_features(documents: DataFrame) -> DataFrame:
    """Numeric text features per document (all built-in expressions)."""
    w = tx.letters_only_words("text")
    return documents.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(w).cast("double").alias("n_words"),
        F.size(tx.sentences("text")).cast("double").alias("n_sentences"),
        F.try_divide(F.size(F.array_distinct(w)).cast("double"), F.size(w)).alias("distinct_share"),
        F.try_divide(F.length(F.array_join(w, "")).cast("double"), F.size(w)).alias("mean_word_len"),
        F.try_divide(F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double"), F.length("text"))
        .alias("upper_share"),
        (F.col("lang") == "en").cast("double").alias("is_en"),
    ).fillna(0.0)


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def classifier(kind: str, label: str = "label", seed: int = 42, **kw):
    if kind == "rf":
        return RandomForestClassifier(labelCol=label, featuresCol="features", impurity="entropy",
                                      numTrees=kw.get("trees", 50), seed=seed)
    if kind == "gbt":
        return GBTClassifier(labelCol=label, featuresCol="features", maxIter=kw.get("iters", 20),
                             maxDepth=kw.get("depth", 5), stepSize=kw.get("step", 0.1),
                             subsamplingRate=kw.get("subsample", 1.0), seed=seed)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=kw["layers"],
                                              maxIter=kw.get("iters", 100), seed=seed)
    if kind == "lr":
        return LogisticRegression(labelCol=label, featuresCol="features", maxIter=kw.get("iters", 50))
    raise ValueError(kind)


def regressor(kind: str, label: str = "label", seed: int = 42, **kw):
    if kind == "rf":
        return RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=kw.get("trees", 50), seed=seed)
    if kind == "gbt":
        return GBTRegressor(labelCol=label, featuresCol="features", maxIter=kw.get("iters", 20),
                            maxDepth=kw.get("depth", 5), stepSize=kw.get("step", 0.1),
                            subsamplingRate=kw.get("subsample", 0.8), seed=seed)
    if kind == "lasso":
        return LinearRegression(labelCol=label, featuresCol="features", elasticNetParam=1.0,
                                regParam=kw.get("alpha", 0.1))
    raise ValueError(kind)


def fit_predict(train: DataFrame, test: DataFrame, estimator, feature_cols, keep=()):
    """Fit on ``train``, score ``test``; returns (model, predictions with p1 = P(class 1))."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(feature_cols), outputCol="features",
                                            handleInvalid="keep"), estimator])
    model = pipe.fit(train)
    pred = model.transform(test)
    cols = list(keep) + ["prediction"]
    if "probability" in pred.columns:
        pred = pred.withColumn("p1", vector_to_array("probability")[1])
        cols.append("p1")
    return model, pred.select(*cols)


def to_class(p, threshold: float = 0.5):
    """M8: probability -> class."""
    return (F.col(p) >= threshold).cast("int") if isinstance(p, str) else (p >= threshold).cast("int")


def importances(model, feature_cols, n: int = 100) -> DataFrame:
    """Feature importances with names, descending, first n."""
    from pyspark.sql import SparkSession

    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(feature_cols, imp), key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame([(c, float(v), i + 1) for i, (c, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def out_of_fold(df: DataFrame, fold_col: str, k: int, make_estimator, feature_cols, key: str, name: str) -> DataFrame:
    """M6 base layer: P(class 1) for every row from a model not trained on its fold."""
    parts = []
    for f in range(k):
        _, pred = fit_predict(df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f),
                              make_estimator(), feature_cols, keep=[key])
        parts.append(pred.select(key, F.col("p1").alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stack(df: DataFrame, fold_col: str, k: int, base: dict, feature_cols, key: str, label: str) -> DataFrame:
    """Out-of-fold base probabilities joined side by side on the
    row key, then a logistic-regression meta model that scores each fold
    from a fit on the others. The features and the base layer are written
    once; every fit reads them several times."""
    df = cut_lineage(df)
    meta = df.select(key, label, fold_col)
    for name, make in base.items():
        meta = meta.join(out_of_fold(df, fold_col, k, make, feature_cols, key, name), key)
    meta = cut_lineage(meta)
    names = list(base)
    parts = [fit_predict(meta.where(F.col(fold_col) != f), meta.where(F.col(fold_col) == f), classifier("lr", label), names,
                         keep=[key, label, *names])[1] for f in range(k)]
    return reduce(DataFrame.unionByName, parts)

"""Evaluation metrics as aggregates.

All are single-pass aggregates except the exact weighted AUC, which needs
the rank of every score: scores are grouped (partial aggregation), the
negative weight below each distinct score comes from a distributed prefix
sum, and the result is one more aggregate. Ties count one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.operators.ordering import prefix_sum


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def confusion(df: DataFrame, label, pred, by=()) -> DataFrame:
    """K1 / K4 / K7: tp, fp, fn, tn, precision, recall, f1, accuracy."""
    y, p = _c(label).cast("int"), _c(pred).cast("int")
    aggs = [F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
            F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
            F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
            F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn")]
    a = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    prec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return a.select("*", prec.alias("precision"), rec.alias("recall"),
                    F.try_divide(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                    F.try_divide((F.col("tp") + F.col("tn")).cast("double"),
                                 F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))


def argmax_classes(truth_arr, pred_arr):
    """K2: class = argmax of a two-column (neg, pos) row."""
    return ar.argmax(truth_arr), ar.argmax(pred_arr)


def weighted_auc(df: DataFrame, score, label, weight=None) -> DataFrame:
    """K5: exact weighted ROC AUC (rank-sum, ties 1/2):
    sum_pos w_p (W_neg below s_p + W_neg at s_p / 2) / (W_pos W_neg)."""
    w = F.lit(1.0) if weight is None else _c(weight).cast("double")
    s = df.select(_c(score).cast("double").alias("__s"), _c(label).cast("int").alias("__y"), w.alias("__w"))
    per = s.groupBy("__s").agg(F.sum(F.when(F.col("__y") == 1, F.col("__w")).otherwise(0.0)).alias("__wp"),
                               F.sum(F.when(F.col("__y") == 0, F.col("__w")).otherwise(0.0)).alias("__wn"))
    below = prefix_sum(per, [F.asc("__s")], "__wn", "__nb", inclusive=False)
    return below.agg(
        F.try_divide(F.sum(F.col("__wp") * (F.col("__nb") + F.col("__wn") / 2)),
                     F.sum("__wp") * F.sum("__wn")).alias("auc"),
        F.sum("__wp").alias("w_pos"), F.sum("__wn").alias("w_neg"))


def masked_bce(df: DataFrame, y_arr, p_arr, mask_arr, eps: float = 1e-7) -> DataFrame:
    """K6: per example sum(bce * mask) / sum(mask), then the mean over examples."""
    z = F.arrays_zip(_c(y_arr).alias("y"), _c(p_arr).alias("p"), _c(mask_arr).alias("m"))

    def bce(e):
        p = F.least(F.greatest(e["p"].cast("double"), F.lit(eps)), F.lit(1 - eps))
        y = e["y"].cast("double")
        return -(y * F.log(p) + (1 - y) * F.log(1 - p)) * e["m"].cast("double")
    num = F.aggregate(F.transform(z, bce), F.lit(0.0), lambda a, x: a + x)
    den = F.aggregate(_c(mask_arr), F.lit(0.0), lambda a, x: a + x.cast("double"))
    per = df.select(F.try_divide(num, den).alias("__l"))
    return per.agg(F.avg("__l").alias("masked_bce"), F.count("__l").alias("n_examples"))


def reconstruction_error(a, b) -> Column:
    """K8: mean squared difference of two equal-length vectors."""
    return ar.sq_dist(a, b) / F.size(_c(a))

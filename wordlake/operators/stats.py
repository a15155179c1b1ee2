"""Statistics operators.

Exact quantiles use a distributed sort and global positions instead of
``percentile`` (which buffers a group's values in one task): a group that
holds a third of all rows is spread over many sorted partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordlake.operators.ordering import global_index, prefix_sum


def exact_quantiles(df: DataFrame, value_col: str, qs=(0.25, 0.5, 0.75), by=()) -> DataFrame:
    """Linear-interpolated quantiles (pandas/numpy 'linear', DuckDB quantile_cont)."""
    by = list(by)
    v = df.where(F.col(value_col).isNotNull()).select(*by, F.col(value_col).cast("double").alias("__v"))
    pos = global_index(v, [*[F.asc(c) for c in by], F.asc("__v")], "__g")
    stats = pos.groupBy(*by).agg(F.min("__g").alias("__start"), F.count(F.lit(1)).alias("__n"))
    qdf = v.sparkSession.createDataFrame([(float(q), i) for i, q in enumerate(qs)], "__q double, __qi int")
    targets = stats.crossJoin(F.broadcast(qdf)).withColumn("__p", F.col("__q") * (F.col("__n") - 1)) \
        .withColumn("__lo", F.col("__start") + F.floor("__p").cast("long")) \
        .withColumn("__hi", F.col("__start") + F.ceil("__p").cast("long")) \
        .withColumn("__frac", F.col("__p") - F.floor("__p"))
    ends = targets.select(*by, "__qi", "__frac", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("__lo").alias("at")),
        F.struct(F.lit(1).alias("side"), F.col("__hi").alias("at")))).alias("__e"))
    hit = ends.join(pos.select(F.col("__g"), F.col("__v")), F.col("__e.at") == F.col("__g"))
    per_q = hit.groupBy(*by, "__qi", "__frac").agg(
        F.max(F.when(F.col("__e.side") == 0, F.col("__v"))).alias("__vlo"),
        F.max(F.when(F.col("__e.side") == 1, F.col("__v"))).alias("__vhi"))
    per_q = per_q.withColumn("__val", F.col("__vlo") + F.col("__frac") * (F.col("__vhi") - F.col("__vlo")))
    names = [f"q{int(round(q * 100)):02d}" for q in qs]
    aggs = [F.max(F.when(F.col("__qi") == i, F.col("__val"))).alias(n) for i, n in enumerate(names)]
    if by:
        return per_q.groupBy(*by).agg(*aggs)
    return per_q.agg(*aggs)


def describe(df: DataFrame, value_col: str, by=()) -> DataFrame:
    """A4: count, mean, std (n-1), min, 25/50/75 % (linear), max."""
    by = list(by)
    basic_aggs = [F.count(value_col).alias("count"), F.avg(value_col).alias("mean"),
                  F.stddev_samp(value_col).alias("std"), F.min(value_col).cast("double").alias("min"),
                  F.max(value_col).cast("double").alias("max")]
    basic = df.groupBy(*by).agg(*basic_aggs) if by else df.agg(*basic_aggs)
    qs = exact_quantiles(df, value_col, by=by)
    return basic.join(qs, by) if by else basic.crossJoin(qs)


def bin_table(spark, n_bins: int) -> DataFrame:
    return spark.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))


def histogram(df: DataFrame, value_col: str, bins: int = 10, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """A8 with evenly spaced edges (numpy.histogram): half-open bins, the last
    bin closed, values outside [lo, hi] dropped, empty bins reported as 0.
    Range defaults to the data's [min, max] (a one-row aggregate)."""
    x = F.col(value_col).cast("double")
    if lo is None or hi is None:
        rng = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    else:
        rng = df.sparkSession.range(1).select(F.lit(float(lo)).alias("__lo"), F.lit(float(hi)).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo"))
    with_rng = df.select(x.alias("__x")).crossJoin(F.broadcast(rng))
    b = F.least(F.floor((F.col("__x") - F.col("__lo")) / width * bins).cast("int") + 1, F.lit(bins))
    inside = with_rng.where((F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
    counts = inside.groupBy(F.when(width == 0, F.lit(1)).otherwise(b).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("count"))
    bt = bin_table(df.sparkSession, bins).crossJoin(F.broadcast(rng))
    out = bt.join(counts, "bin", "left").select(
        "bin",
        (F.col("__lo") + (F.col("bin") - 1) * width / bins).alias("lo"),
        (F.col("__lo") + F.col("bin") * width / bins).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
    return out


def histogram_edges(df: DataFrame, value_col: str, edges) -> DataFrame:
    """A8 with explicit, increasing edges: bin i is [e_i, e_i+1), last closed."""
    edges = [float(e) for e in edges]
    n = len(edges) - 1
    x = F.col(value_col).cast("double")
    arr = F.array(*[F.lit(e) for e in edges])
    b = F.when(x == edges[-1], F.lit(n)).otherwise(F.size(F.filter(arr, lambda e: e <= x)))
    counts = df.where((x >= edges[0]) & (x <= edges[-1])).groupBy(b.alias("bin")) \
        .agg(F.count(F.lit(1)).alias("count"))
    bt = df.sparkSession.createDataFrame([(i + 1, edges[i], edges[i + 1]) for i in range(n)],
                                         "bin int, lo double, hi double")
    return bt.join(counts, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def ecdf(df: DataFrame, value_col: str, out: str = "ecdf") -> DataFrame:
    """Per row, the fraction of values strictly below it.

    Value counts (partial aggregation) -> exclusive running sum over the
    sorted distinct values (`prefix_sum`, no global window) -> join back.
    """
    vc = df.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("__val")) \
        .agg(F.count(F.lit(1)).alias("__c"))
    below = prefix_sum(vc, [F.asc("__val")], "__c", "__below", inclusive=False)
    total = vc.agg(F.sum("__c").alias("__n"))
    j = df.join(below.select("__val", "__below"), F.col(value_col) == F.col("__val"), "left") \
        .crossJoin(F.broadcast(total))
    return j.withColumn(out, F.try_divide(F.col("__below").cast("double"), F.col("__n"))) \
        .drop("__val", "__below", "__n")


def expon_fit(df: DataFrame, value_col: str, by=()) -> DataFrame:
    """Exponential MLE, loc = min, scale = mean - min."""
    aggs = [F.min(value_col).cast("double").alias("loc"),
            (F.avg(value_col) - F.min(value_col)).alias("scale")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def class_balance(df: DataFrame, label_col: str) -> DataFrame:
    """A10: positives, negatives, neg/pos weight, fraction positive, and the
    accuracy of always answering the majority class."""
    y = F.col(label_col)
    a = df.agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
               F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("neg"))
    return a.select("pos", "neg",
                    F.try_divide(F.col("neg").cast("double"), F.col("pos")).alias("neg_per_pos"),
                    F.try_divide(F.col("pos").cast("double"), F.col("pos") + F.col("neg")).alias("frac_pos"),
                    F.try_divide(F.greatest("pos", "neg").cast("double"), F.col("pos") + F.col("neg"))
                    .alias("majority_acc"))


def differences(bins: DataFrame, order_col: str, y_col: str) -> DataFrame:
    """W6 on a bounded bin table: d1 = y[i]-y[i+1], d2 = d1[i]-d1[i+1], and
    the elbow = first bin with the largest d2."""
    w = Window.orderBy(order_col)
    d = bins.withColumn("d1", F.col(y_col) - F.lead(y_col).over(w))
    d = d.withColumn("d2", F.col("d1") - F.lead("d1").over(w))
    best = d.where(F.col("d2").isNotNull()).agg(
        F.min_by(order_col, F.struct(-F.col("d2"), F.col(order_col))).alias("__elbow"))
    return d.crossJoin(best).withColumn("is_elbow", (F.col(order_col) == F.col("__elbow")).cast("int")) \
        .drop("__elbow")


def fit_exponential_decay(points: DataFrame, x_col: str, y_col: str, iterations: int = 20) -> dict:
    """Least-squares y = a * exp(-b x) on a bounded point table (bins).

    Start from the log-linear fit (regr_slope/regr_intercept of ln y), then
    Gauss-Newton steps on the bins, which are computed once. ``points`` has
    one row per bin, so its size is a parameter, not the data's."""
    x, y = F.col(x_col).cast("double"), F.col(y_col).cast("double")
    bins = [(r.x, r.y) for r in points.select(x.alias("x"), y.alias("y")).dropna().collect()]
    logs = [(u, math.log(v)) for u, v in bins if v > 0]
    mx, ml = (sum(p[i] for p in logs) / max(1, len(logs)) for i in (0, 1))
    spread = sum((u - mx) ** 2 for u, _ in logs)
    slope = sum((u - mx) * (v - ml) for u, v in logs) / spread if spread else 0.0
    a, b = math.exp(ml - slope * mx), -slope
    for _ in range(iterations):
        s = dict.fromkeys(("aa", "ab", "bb", "ar", "br"), 0.0)
        for u, v in bins:
            ja = math.exp(-b * u)
            jb, res = -a * u * ja, v - a * ja
            for k, t in (("aa", ja * ja), ("ab", ja * jb), ("bb", jb * jb), ("ar", ja * res), ("br", jb * res)):
                s[k] += t
        det = s["aa"] * s["bb"] - s["ab"] ** 2
        if not det:
            break
        da = (s["bb"] * s["ar"] - s["ab"] * s["br"]) / det
        db = (s["aa"] * s["br"] - s["ab"] * s["ar"]) / det
        a, b = a + da, b + db
        if abs(da) < 1e-12 * max(1.0, abs(a)) and abs(db) < 1e-12 * max(1.0, abs(b)):
            break
    return {"a": a, "b": b}

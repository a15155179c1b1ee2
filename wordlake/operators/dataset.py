"""Dataset assembly.

Randomness is a seeded hash of the row key (``math.hash_unit``), so results
do not depend on partitioning or retries: a re-run task after an executor
loss draws the same numbers. Per-class ranks come from one global order over
(class, hash, key) instead of a window partitioned by class, so a class that
holds half the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlake.functions.math import hash_bucket, hash_unit
from wordlake.operators.ordering import global_index


def hash_split(df: DataFrame, key, seed: int, train_frac: float = 0.8, out: str = "split") -> DataFrame:
    """Deterministic random split, no join: 'train' when the
    key's hash bucket (of 1000) is below train_frac * 1000."""
    keys = [key] if isinstance(key, str) else list(key)
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in keys]) if len(keys) > 1 else F.col(keys[0])
    return df.withColumn(out, F.when(hash_bucket(k, seed, 1000) < int(round(train_frac * 1000)), "train")
                         .otherwise("test"))


def ordered_split(df: DataFrame, order_cols, test_frac: float = 0.2, out: str = "split") -> DataFrame:
    """D3: no shuffle: the first n - ceil(test_frac * n) rows in order are train."""
    idx = global_index(df, order_cols, "__i")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    j = idx.crossJoin(F.broadcast(n))
    cut = F.col("__n") - F.ceil(F.col("__n") * test_frac)
    return j.withColumn(out, F.when(F.col("__i") < cut, "train").otherwise("test")).drop("__i", "__n")


def class_rank(df: DataFrame, label_col: str, order_cols, out: str = "class_rank") -> DataFrame:
    """0-based rank of each row inside its class along ``order_cols``."""
    idx = global_index(df, [F.asc(label_col), *order_cols], "__g")
    start = idx.groupBy(label_col).agg(F.min("__g").alias("__s"))
    return idx.join(start, label_col).withColumn(out, F.col("__g") - F.col("__s")).drop("__g", "__s")


def undersample(df: DataFrame, label_col: str, key: str, seed: int | None = None) -> DataFrame:
    """D4 (seeded random) / D5 (seed None: first rows by key): every class
    keeps as many rows as the smallest class has."""
    order = [F.asc(key)] if seed is None else [hash_unit(key, seed), F.asc(key)]
    ranked = class_rank(df, label_col, order)
    smallest = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__c")).agg(F.min("__c").alias("__m"))
    return ranked.crossJoin(F.broadcast(smallest)).where(F.col("class_rank") < F.col("__m")).drop("__m", "class_rank")


def shuffle_rank(df: DataFrame, key: str, seed: int, out: str = "rank") -> DataFrame:
    """A seeded permutation (position after ordering by the key's hash)."""
    return global_index(df, [hash_unit(key, seed), F.asc(key)], out)


def stratified_folds(df: DataFrame, label_col: str, key: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Class-stratified folds: rank inside the class (seeded hash order) mod k."""
    r = class_rank(df, label_col, [hash_unit(key, seed), F.asc(key)])
    return r.withColumn(out, (F.col("class_rank") % k).cast("int")).drop("class_rank")


#: rows that one task may take in order
FEW_ROWS = 100_000


def prefix_rows(df: DataFrame, order_cols, n: int) -> DataFrame:
    """The first n rows in order (exact). Few rows are a limit on the order, which keeps n rows a partition before
    they meet; more than ``FEW_ROWS`` get order numbers instead, so that no task has to hold them all."""
    if n <= FEW_ROWS:
        return df.orderBy(*order_cols).limit(n)
    return global_index(df, order_cols, "__i").where(F.col("__i") < n).drop("__i")


def balanced_weights(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    """weight = n / (classes * n_class), joined from the small class table."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__c"))
    tot = c.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = c.crossJoin(tot).select(label_col, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias(out))
    return df.join(w, label_col)


def random_window(arr, size: int, key, seed: int):
    """One seeded random window of ``size`` per sequence (none if shorter)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    m = F.size(a) - size + 1
    start = (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10)
             .cast("long") % F.greatest(m, F.lit(1))).cast("int")
    return F.when(m >= 1, F.struct(start.alias("start"), F.slice(a, start + 1, size).alias("window")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """N rows in seeded hash order (the limit is the feature)."""
    return df.orderBy(hash_unit(key, seed), F.asc(key)).limit(n)


def num_skips_contexts(arr, skip_window: int, num_skips: int, key, seed: int):
    """Per position, ``num_skips`` distinct offsets drawn from
    +-1..skip_window (seeded by key, position and offset), with contexts."""
    a = F.col(arr) if isinstance(arr, str) else arr
    n = F.size(a)
    offs = F.array(*[F.lit(o) for o in list(range(-skip_window, 0)) + list(range(1, skip_window + 1))])

    def at(i):
        valid = F.filter(offs, lambda o: (i + o >= 1) & (i + o <= n))
        keyed = F.transform(valid, lambda o: F.struct(
            F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), o.cast("string"), F.lit(str(seed))))
            .alias("h"), o.alias("o")))
        chosen = F.slice(F.array_sort(keyed), 1, num_skips)
        return F.transform(chosen, lambda c: F.struct((i - 1).alias("pos"), c["o"].alias("offset"),
                                                      F.element_at(a, i).alias("word"),
                                                      F.element_at(a, i + c["o"]).alias("context")))
    return F.when(n >= 1, F.flatten(F.transform(F.sequence(F.lit(1), n), at)))

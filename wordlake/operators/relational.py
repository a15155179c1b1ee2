"""Relational operators re-expressed for Spark (P, J, A1-A7, O, U).

Most are one DataFrame call; the functions here fix the semantics the
reference relies on (suffixing of colliding columns, NULL instead of inf on
division by zero, default vectors on lookup misses, tie-broken ordering).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(num, den) -> Column:
    """Num / den, NULL when den is 0 (ANSI Spark raises on x/0)."""
    return F.try_divide(F.col(num) if isinstance(num, str) else num,
                        F.col(den) if isinstance(den, str) else den)


def scale_by_max(df: DataFrame, col: str, out: str | None = None, by=None) -> DataFrame:
    """X / max(x). The max is a one-row aggregate joined back
    (broadcast of one row), not an unpartitioned window."""
    out = out or f"{col}_scaled"
    mx = df.agg(F.max(col).alias("__mx")) if by is None else df.groupBy(*by).agg(F.max(col).alias("__mx"))
    j = df.crossJoin(F.broadcast(mx)) if by is None else df.join(mx, by)
    return j.withColumn(out, F.try_divide(F.col(col), F.col("__mx"))).drop("__mx")


def select_keys(df: DataFrame, col: str, keys) -> DataFrame:
    """The rows whose ``col`` is one of a few given keys."""
    return df.where(F.col(col).isin(list(keys)))


def threshold_label(col, threshold, op: str = ">=") -> Column:
    """1 when col (op) threshold else 0."""
    c = F.col(col) if isinstance(col, str) else col
    cond = {">=": c >= threshold, ">": c > threshold, "<=": c <= threshold, "<": c < threshold}[op]
    return cond.cast("int")


def merge(left: DataFrame, right: DataFrame, left_on, right_on, how: str = "inner",
          suffixes=("_x", "_y")) -> DataFrame:
    """Equi-join with different key names; non-key columns present on
    both sides get suffixes, as pandas ``merge`` does."""
    left_on = [left_on] if isinstance(left_on, str) else list(left_on)
    right_on = [right_on] if isinstance(right_on, str) else list(right_on)
    same = [c for c in left.columns if c in right.columns]
    shared_keys = {lk for lk, rk in zip(left_on, right_on) if lk == rk}
    lren = {c: c + suffixes[0] for c in same if c not in shared_keys}
    rren = {c: c + suffixes[1] for c in same if c not in shared_keys}
    lr = left.withColumnsRenamed(lren)
    rr = right.withColumnsRenamed(rren)
    if shared_keys and len(shared_keys) == len(left_on):
        return lr.join(rr, list(left_on), how)
    cond = None
    for lk, rk in zip(left_on, right_on):
        e = lr[lren.get(lk, lk)] == rr[rren.get(rk, rk)]
        cond = e if cond is None else cond & e
    return lr.join(rr, cond, how)


def lookup_with_default(keys: DataFrame, table: DataFrame, key_col: str, table_key: str,
                        value_col: str, default: Column, out: str | None = None) -> DataFrame:
    """Left join to a lookup table; misses get ``default`` (a Column,
    e.g. a zero vector or the vector of another key)."""
    out = out or value_col
    t = table.select(F.col(table_key).alias("__k"), F.col(value_col).alias("__v"))
    j = keys.join(t, keys[key_col] == t["__k"], "left")
    return j.withColumn("hit", F.col("__k").isNotNull().cast("int")) \
        .withColumn(out, F.coalesce(F.col("__v"), default)).drop("__k", "__v")


def coverage(tokens: DataFrame, table: DataFrame, token_col: str, table_key: str) -> DataFrame:
    """Matched / total tokens after a semi-join reduction of the table."""
    t = table.select(F.col(table_key).alias("__k")).distinct()
    j = tokens.join(t, tokens[token_col] == t["__k"], "left")
    return j.agg(F.count(F.lit(1)).alias("total"),
                 F.count("__k").alias("matched")).withColumn(
        "coverage", F.try_divide(F.col("matched").cast("double"), F.col("total")))


def top_n(df: DataFrame, n: int, order_cols) -> DataFrame:
    """O2 / O3: orderBy + limit (TakeOrderedAndProject: per-partition top-n,
    then a merge of n x partitions rows)."""
    return df.orderBy(*order_cols).limit(n)


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int, rank: str = "rank") -> DataFrame:
    """Top-n per key; the `rank <= n` filter lets Catalyst insert a
    WindowGroupLimit before the shuffle (partial top-n per partition)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n) \
        .withColumn(rank, F.col(rank).cast("long"))


def labelled_union(a: DataFrame, b: DataFrame, label_a, label_b, label: str = "label") -> DataFrame:
    """U2."""
    return a.withColumn(label, F.lit(label_a)).unionByName(b.withColumn(label, F.lit(label_b)))


def symmetric_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, rest) plus (b, a, rest)."""
    rest = [c for c in df.columns if c not in (a, b)]
    swapped = df.select(F.col(b).alias(a), F.col(a).alias(b), *rest)
    return df.unionByName(swapped)


def having_count(df: DataFrame, key: str, min_count: int = 2) -> DataFrame:
    """A1 + A2: keys with at least ``min_count`` rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def describe_text(df: DataFrame, col: str) -> DataFrame:
    """A5: count, unique, top (most frequent; ties: smallest value), freq."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col))).alias("top"),
        F.max("n").alias("freq"),
    )

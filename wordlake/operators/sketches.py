"""Distinct counts by mergeable sketches, kept as columns.

A sketch takes a few KB whatever it has seen, and two sketches make one of both inputs. So a hot group is split by a
salt and its parts merged, parts may be kept per day or source and merged over any grouping later, and no task holds a
group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch are 2 ** BITS; the relative standard error is about 1.04 / 2 ** (BITS / 2).
BITS, SALTS = 12, 16


def standard_error(bits: int = BITS) -> float:
    return 1.04 / 2 ** (bits / 2)


def distinct_sketches(df: DataFrame, keys, value_col: str, bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """(keys..., sketch): one sketch per group, from ``salts`` partial ones each. Null values are not counted."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    salted = df.groupBy(*keys, F.pmod(F.xxhash64(value_col), F.lit(salts)).alias("__salt")).agg(F.hll_sketch_agg(value_col, F.lit(bits)).alias("sketch"))
    return merged(salted, keys)


def merged(sketches: DataFrame, keys) -> DataFrame:
    """(keys..., sketch): the sketches of each coarser group in one."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame, out: str = "n") -> DataFrame:
    """The sketches' distinct counts in place of the sketches."""
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")

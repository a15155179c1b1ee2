"""Scalable global order numbers.

An unpartitioned window (``row_number() OVER (ORDER BY ...)``) moves every
row into one task. Instead: a distributed range sort, the row position
inside each sorted partition from ``monotonically_increasing_id``, a tiny
per-partition count table, its prefix sums, and a broadcast join back. The
count table has one row per partition, so its broadcast is bounded by the
partition count, not by the data.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PID = "__wl_pid"
_POS = "__wl_pos"


def global_index(df: DataFrame, order_cols, name: str = "idx", start: int = 0) -> DataFrame:
    """Add a dense 0..n-1 (+start) position following a total order.

    ``order_cols`` must define a total order (add a unique tie-break key),
    otherwise positions of tied rows are not deterministic.
    """
    sorted_df = (
        df.orderBy(*order_cols)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    counts = sorted_df.groupBy(_PID).agg(F.count(F.lit(1)).alias("__wl_n"))
    offsets = counts.select(
        _PID,
        (F.sum("__wl_n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1))).alias("__wl_off"),
    ).fillna(0, subset=["__wl_off"])
    out = (
        sorted_df.join(F.broadcast(offsets), _PID)
        .withColumn(name, (F.col("__wl_off") + F.col(_POS) + F.lit(start)).cast("long"))
        .drop(_PID, _POS, "__wl_off")
    )
    return out


def small_rank(df: DataFrame, order_cols, name: str = "idx", start: int = 0) -> DataFrame:
    """row_number over a table already bounded in size (bins, top-k lists)."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*order_cols)) - 1 + start).cast("long"))


def prefix_sum(df: DataFrame, order_cols, value_col: str, name: str = "cum",
               inclusive: bool = True) -> DataFrame:
    """Running sum of ``value_col`` along a total order, without a global window.

    One range sort; a narrow per-partition running sum (``mapInPandas``,
    the sorted partition streams through in Arrow batches); per-partition
    totals (one row per partition) turned into offsets and broadcast back.
    """
    vtype = df.schema[value_col].dataType
    out_schema = T.StructType(list(df.schema.fields) + [
        T.StructField(_PID, T.IntegerType()), T.StructField("__wl_local", vtype)])

    def local_cumsum(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        run = 0
        for pdf in batches:
            v = pdf[value_col].fillna(0)
            c = v.cumsum() + run
            run = c.iloc[-1] if len(c) else run
            pdf[_PID] = pid
            pdf["__wl_local"] = c if inclusive else c - v
            yield pdf

    local = df.orderBy(*order_cols).mapInPandas(local_cumsum, out_schema) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    totals = local.groupBy(_PID).agg(F.sum(F.coalesce(F.col(value_col), F.lit(0))).alias("__wl_tot"))
    offsets = totals.select(
        _PID,
        F.coalesce(F.sum("__wl_tot").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__wl_off"))
    return (local.join(F.broadcast(offsets), _PID)
            .withColumn(name, (F.col("__wl_off") + F.col("__wl_local")).cast(vtype))
            .drop(_PID, "__wl_local", "__wl_off"))

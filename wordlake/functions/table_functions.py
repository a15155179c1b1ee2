"""Table functions, one row (or a partition's rows) to many, with a schema worked out from the arguments."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import IntegerType, StructType


class Windows:
    """``windows(TABLE(t), key, order, value, size)``: all stretches of ``size`` consecutive values of a key, by the order.

    Columns: the key, ``start`` (from 0) and ``w1`` to ``w<size>`` of the value's type. The result names the partitioning
    and the order itself, so a call needs neither. A partition's rows stream through; the function holds ``size`` values.
    Keys with fewer rows have no windows; null values stay in place.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, StructType):
            raise ValueError("the first argument must be a table")
        if not isinstance(size.value, int) or size.value < 1:
            raise ValueError("size must be a constant of at least 1")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        for name in (key.value, order.value, value.value):
            if name not in kinds:
                raise ValueError(f"no column {name}")
        schema = StructType().add(key.value, kinds[key.value]).add("start", IntegerType())
        for i in range(size.value):
            schema = schema.add(f"w{i + 1}", kinds[value.value])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def __init__(self):
        self._held: deque | None = None
        self._start = 0

    def eval(self, rows, key: str, order: str, value: str, size: int):
        if self._held is None:
            self._held = deque(maxlen=size)
        self._held.append(rows[value])
        if len(self._held) == size:
            yield (rows[key], self._start, *self._held)
            self._start += 1


def register(spark: SparkSession, name: str = "windows") -> None:
    """Makes ``windows`` callable from SQL."""
    spark.udtf.register(name, F.udtf(Windows))


def windows(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """The same on a DataFrame."""
    return F.udtf(Windows)(df.asTable(), F.lit(key), F.lit(order), F.lit(value), F.lit(size))

"""Structured Streaming for the row-wise operators.

The reference has no streaming operator (SURVEY 2.12). Row-wise operators
(text cleaning, tokenizing, features, lookups against a static table) keep
no driver state, so the same Column expressions run unchanged on a
streaming DataFrame. ``run_available`` drains a file source with the
``availableNow`` trigger into a parquet sink with its own checkpoint
location (exactly-once file sink, restartable after failure).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def file_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink_dir: str,
                  checkpoint_dir: str) -> None:
    """Apply a row-wise transform to everything available and stop."""
    q = (transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()

"""Session construction and lineage management.

On a cluster the session is created by the platform; `build_session` is for
tests, the bench and local runs. `checkpoint_dir` reads the shared folder
named by ``spark.checkpoint.dir`` and only sets a local one when it is unset
(tests), so iterative jobs can cut lineage with ``DataFrame.checkpoint``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "wordlake") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WORDLAKE_DRIVER_MEM", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only if unset."""
    conf = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="wordlake-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, conf)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared checkpoint folder and
    read back (one job; reliable storage that survives executor loss)."""
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/wordlake-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def free_unused(spark: SparkSession) -> None:
    """Collect the driver's unused plans, so that Spark drops their shuffle files."""
    spark._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that `cut_lineage` wrote and nothing reads any more, and what its plans left."""
    jvm = df.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    if folder.getName().startswith("wordlake-"):
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    free_unused(df.sparkSession)

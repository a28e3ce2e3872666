"""Session helpers: table access, checkpoints, Python path of the workers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed, and get texts in smaller batches."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default, which makes long texts large batches
        spark.conf.set(BATCH_ROWS, "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors don't lose it.

    The folder is spark.checkpoint.dir. Where the session names none, a temporary one
    is set on a local master, as in tests; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def local_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder of this machine, for sessions that run on it alone."""
    if not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"variorum-{name}-")


def is_local(master: str) -> bool:
    """Whether a master runs everything in the driver; local-cluster doesn't."""
    return master == "local" or master.startswith("local[")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in a fixed number of partitions: adaptive plans join partitions of few bytes, however long their rows take in a function."""
    n = max(parallelism(df.sparkSession), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Streaming twins of the batch operators over event logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.runtime import local_folder


def shared_folder(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir', None) or local_folder(spark, 'stream')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, run through the stream; each batch's result replaces or follows the last one's in the shared folder."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    write = "overwrite" if mode == "complete" else "append"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode(write).parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """ST1's window: counts and sums per window and type, late rows dropped after a day."""
    kind = dict(events.dtypes)["ts"]
    w = F.window("ts", width)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("positive")).select(F.col("window.start").cast(kind).alias("start"), "event_type", "n", "positive")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST8: a user's rows up to a gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_rows(events: DataFrame) -> DataFrame:
    """ST1: a log replayed twice counts once."""
    return events.dropDuplicates(["event_id"])


def monitor(events: DataFrame, history: int = 10, least: int = 5, drop: float = 0.2) -> DataFrame:
    """ST7, W5, F29 in batch: rows whose value is well below the mean of the user's last ones."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-history, -1)
    seen, mean = F.count("value").over(w), F.avg("value").over(w)
    return events.select("event_id", "user_id", seen.alias("seen"), F.coalesce((seen >= least) & (F.col("value") < mean * (1 - drop)), F.lit(False)).alias("regressed"))


def upsert(log: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """ST2, J29, S27: the last row of each key."""
    return log.groupBy(key).agg(F.max(F.struct(*order, *(c for c in log.columns if c not in (key, *order)))).alias("r")).select(key, "r.*")


def sink(spark: SparkSession, stream: DataFrame, path: str, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """ST1 to ST4: appends what is new to a table; the checkpoint beside it makes batches count once."""
    stream.transform(then).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}_state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

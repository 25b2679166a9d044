"""Streaming twins of the batch windows: a file source, a watermark and a Parquet sink, run until all there is has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflux.plans.lineage import shared_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or one file."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{{{name},}}").withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All rows of the stream's last state, through the shared folder."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_daily(spark: SparkSession, path: str) -> DataFrame:
    rows = source(spark, path).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return _drain(spark, rows, "complete").select(F.col("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def run_sessions(spark: SparkSession, path: str, gap: str = "6 hours") -> DataFrame:
    rows = source(spark, path).withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return _drain(spark, rows, "complete").select("user_id", F.col("s.start").alias("first_ts"), "n")

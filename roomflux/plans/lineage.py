"""Lineage cuts that survive lost executors.

Every cut is a Parquet table in the shared folder named by ``spark.checkpoint.dir``. A folder is made only where the
session names none and runs in one process (tests, local runs); on a cluster that is an error, as executors would write to
folders of their own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{KEY} names no shared folder for {master}")
        found = "file://" + tempfile.mkdtemp(prefix="roomflux-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back; the rows no longer depend on earlier stages."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._roomflux_path = path
    return back


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame that ``materialize`` returned and that nothing reads any more."""
    path = getattr(df, "_roomflux_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession) -> None:
    """Has the driver collect its garbage, for loops of many rounds: shuffles and broadcasts of rounds that are done stay, here and on the executors, until it does."""
    gc.collect()
    spark._jvm.System.gc()

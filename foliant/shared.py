"""Scratch tables in the folder that driver and executors share, removed when the driver's program ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names; a folder of the warehouse only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for the tables of one run; it goes with the program at the latest."""
    folder = f"{shared_folder(spark)}/foliant-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not _MADE:
        atexit.register(clear)
    _MADE.append((path, path.getFileSystem(spark._jsc.hadoopConfiguration())))
    return folder


def clear() -> None:
    """Remove every scratch folder of this program that is still there."""
    while _MADE:
        path, store = _MADE.pop()
        try:
            store.delete(path, True)
        except Exception:  # the virtual machine may have ended first; nothing is lost but space
            return


def kept(df: DataFrame, folder: str) -> DataFrame:
    """A table written once and read from then on, so what made it neither runs again nor can differ."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt to all cores where its files are too few for them, as one file of one row group is one task's work; larger scans stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    each = 128 << 20  # what a scan task takes at most
    return df.repartition(2 * cores) if size < cores * each else df

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the corpus, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


BATCH_ROWS, BATCH_BYTES = 1_000, 2 << 20

#: Tables that a Python worker keeps between tasks, of one operator at a time: another one's are dropped first.
_KEPT: dict[str, dict] = {}


def worker_tables(operator: str) -> dict:
    """The tables of an operator in this Python worker; those of all others go."""
    for other in [k for k in _KEPT if k != operator]:
        del _KEPT[other]
    return _KEPT.setdefault(operator, {})


def give_back() -> None:
    """Return what a task has freed to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, schema: str | StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], keeps: str = "") -> DataFrame:
    """`mapInArrow` over batches of bounded bytes; a task's memory is given back at its end, but for the tables of the operator `keeps`."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables(keeps)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes and rows of a batch that goes to a Python worker; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def column_values(batch: pa.RecordBatch, name: str) -> list:
    """A column of a batch as Python values."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slabs(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about `limit` bytes together, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what `spark.checkpoint.dir` names.

    Only where that is unset (a local test session) a folder of the warehouse is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more, which waits for the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def stage_folder(spark: SparkSession) -> str:
    """A new folder for written stages in the shared folder."""
    return f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that `stage_folder` named, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession, df: DataFrame, bytes_each: int) -> int:
    """Partitions of about `bytes_each` bytes by the planner's size estimate of the scan, at least the shuffle setting.

    The estimate follows the input files, so the count grows in step with the data; without files
    (the planner then assumes an unbounded size) the setting alone counts.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size > 1 << 52 else max(least, min(200_000, -(-size // bytes_each)))

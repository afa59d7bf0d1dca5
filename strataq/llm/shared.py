"""Where intermediate results go, and how workers keep within their memory."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strataq.sessions import checkpoint_folder

__all__ = ["bound_batches", "checkpoint_folder", "frugal", "give_back", "materialise"]


def materialise(df: DataFrame) -> DataFrame:
    """Writes a result to the shared folder and cuts its lineage.

    The shuffle files behind it go as soon as it is written, for nothing can need
    them again.  While it runs, the session's setting for that is on: another query
    that ends in the same session meanwhile loses its own shuffle files too, and one
    that is run again then shuffles anew.  Spark removes the written files when nothing
    refers to them any more, if the session cleans checkpoints.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new query, which takes the setting up
    finally:
        spark.conf.set(name, before)


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Has Spark hand Python at most ``rows`` rows and about ``size`` bytes at once, unless the session sets numbers of its own.

    Texts are long: the default of 10 000 rows makes batches of tens of megabytes,
    held in the JVM and in Python, in and out.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).removesuffix("b") in (str(2**31 - 1), str(256 << 20)):
        spark.conf.set(name, str(size))


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns to the system what Arrow's pool and the C library hold of freed memory."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def frugal(run):
    """A task's work on batches, after which the worker, which lives on, gives freed memory back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped

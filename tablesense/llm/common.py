"""Helpers shared by the training-data operators: shared storage, size checks, text expressions."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesense.session import scratch_folder

#: The code points stripped at line ends and splitting words: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors reach: below ``spark.checkpoint.dir``.

    Where that setting is absent, as in local tests, the session's warehouse folder is used; on a cluster
    a warehouse folder that is local is refused.
    """
    return scratch_folder(spark, name)


def settle(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what led here, and the
    planner knows the true size of what it reads.  ``few``: the caller counted that there are at most some
    BROADCAST_ROWS narrow rows; they become a file for each core, not one for each partition of the shuffle
    before, since every file costs time and, in a local folder, processes that the executor starts.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    if few:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_counted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df``, counted up to the limit, has at most ``limit`` rows.

    Beyond it the frame comes back as it is: Spark then joins by shuffle, with the same rows.
    """
    return F.broadcast(df) if are_few(df, limit) else df


def are_few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """``df``, counted up to the limit, has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other code point as it is.

    ``lower`` agrees on texts of single-byte code points and is far cheaper there.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parallelism(spark: SparkSession) -> int:
    """So many groups at least as the session deals shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows and bytes that go to a Python worker at once: whole texts, so few rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def give_back() -> None:
    """Return the memory that this process has freed to the system: Arrow's pool, and the C library's where it is glibc."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, for ``mapInArrow``, with ``give_back`` at the end of each task: a Python worker lives on beside the steps that follow."""

    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return released


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this library where it was started from a folder and not installed.

    Batches of texts sent to them are kept small, which bounds a worker's memory where texts are long.
    """
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)

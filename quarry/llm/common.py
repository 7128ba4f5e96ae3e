"""Helpers that the training-data operators share: session settings, the shared folder, Arrow glue and text primitives."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.shared import shared_dir, written

#: Rows of an Arrow batch: texts can be long, so a batch holds fewer rows than Spark's default of 10000.
BATCH_ROWS = 2000
#: Bytes of one, where Spark knows such a bound.
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the rows of the Arrow batches that Python workers get, unless the user has set a bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key, "1")).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    return written(df, name)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: they go when its query ends, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """Map Arrow batches one by one; ``make()`` runs once in each task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give freed memory back at a task's end: workers are used again, beside an executor whose own memory grows."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (give := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        give(0)


def crc_mod(col: str, n: int):
    """crc32 of the column's text form, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    """The column's texts; null counts as empty."""
    return [t or "" for t in batch.column(col).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of items whose sizes add up to about ``limit``; an item above it stands alone."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def fmix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


__all__ = ["arrow_map", "crc_mod", "documents", "env_single_thread", "fmix64", "materialize", "shared_dir", "shuffles_removed", "slices", "texts_of", "trim", "tune", "union_all"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def env_single_thread() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")

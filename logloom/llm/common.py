"""Helpers shared by the operators: stored tables, Arrow blocks, table access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Bytes of text that one Python block holds at most, unless one text is longer.
BLOCK_BYTES = 16 << 20
#: Whether Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stored:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str, options: dict[str, str] | None = None):
        self.spark = spark
        self.options = options or {}
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")  # what this step has shuffled is of no use once its table is there
        try:
            df.write.options(**self.options).parquet(path)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """As put(), for the store's result: all tables before it go, so no later step may read them."""
        out = self.put(df)
        for n in range(self.n - 1):
            self.drop(n)
        return out

    def drop(self, n: int) -> None:
        """Delete table n of this store (no later step may read it)."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished steps."""
    trim()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the cleaner works in the background


def trim() -> None:
    """Give memory that Python has freed back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as binary with 64-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and data bytes of a large_binary array without nulls."""
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each block has at most limit bytes, or is a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets, _ = buffers(as_bytes(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    trim()  # the worker may idle on while others need the memory


def needed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: others may clash with what it makes."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))

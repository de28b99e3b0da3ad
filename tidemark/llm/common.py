"""What the operators of this subpackage share: tables, scratch tables and word rules."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.scratch import clear, mark, materialise, remove, scratch_dir, scratch_path

__all__ = ["WORD_PATTERN", "clear", "mark", "materialise", "release", "remove", "scratch_dir", "scratch_path", "small_batches", "table"]

# A word is a maximal run of bytes other than space and 0x09-0x0D; bytes.split() splits at just these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of texts in this session by bytes, unless the user has set a size: ten thousand rows of text are tens of megabytes,
    which both sides hold, in buffers that grow by doubling."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, size)


def release() -> None:
    """Give back what is free in this Python worker: workers stay for later tasks, whose memory would come on top."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)

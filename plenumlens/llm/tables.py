"""Reading tables, column names that cannot clash, and small array helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that split words on white space: blank, tab, newline, vertical tab, form feed, return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of whole texts, at most.
BATCH_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let whole texts go to Python in batches of few rows, since long ones would fill a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def settled(batches: Iterator, every: int = 16) -> Iterator:
    """The batches; now and then, and after the last, Arrow's unused memory goes back to the system.

    A worker that waits for its next task would otherwise hold what its largest batches took.
    """
    for i, batch in enumerate(batches):
        yield batch
        if i % every == every - 1:
            pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))


def cut_points(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of ones in a 0/1 array."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

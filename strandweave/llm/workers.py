"""Keeping Python workers small: they are reused, and what they hold counts for the executor."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch, where the session names no bound of its own.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds batches by bytes, so that long texts don't come ten thousand at a time."""
    if spark.sparkContext.getConf().get(_SETTING) is None:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def named(column: str) -> Column:
    """A column by its exact name, points and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that no name clashes with a helper column; ``row.*`` gives them back."""
    return F.struct(*map(named, docs.columns)).alias(name)


def release() -> None:
    """Gives memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """A batch function that releases its memory at the end of the task."""

    def inner(batches):
        yield from run(batches)
        release()

    return inner

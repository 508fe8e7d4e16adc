"""Intermediate tables in the folder that all machines see."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows sent to a Python worker at a time while a table is kept.
BATCH_BYTES = 8 << 20
#: Rows of a task, about, where a table is dealt by its size.
TASK_ROWS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="leafmill-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, rows go to Python workers in batches of BATCH_BYTES: each is held by the JVM and the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """df computed once, with its lineage cut."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def tasks_of(rows: DataFrame) -> int:
    """Tasks to deal rows to: one for each TASK_ROWS, and no fewer than run at once.  Counts the rows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows, some at a time: those of at most limit bytes in a column of strings, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop

"""Shared plumbing: the folder all executors see, written stages, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows sent to a Python worker at a time by the stages that are written.
BATCH_BYTES = 8 << 20
LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


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


def written(df: DataFrame, kind: str = "stage") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, short lineage, safe from lost executors."""
    path = scratch(df.sparkSession, kind)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, LOWER_FROM, LOWER_TO)


def is_split(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(modulus)) == remainder


def tidy(run: Callable) -> Callable:
    """run for mapInArrow; at a task's end its memory goes back to the system, since workers are used again."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The bytes of a string column, without decoding them."""
    return pc.cast(column, pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most limit bytes in the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at, base = stop, int(ends[stop - 1])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

"""Vectors as exact integers: shared by hard-negative mining and code compression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import column, tidy

#: Sums of products up to here are exact in double precision.
EXACT = 1 << 53


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length, none null, as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // max(1, len(lists)))


def largest(width: int) -> int:
    """The largest magnitude of a component for which squared distances of width components are exact doubles."""
    return max(1, math.isqrt(EXACT // (16 * max(1, width))))


def _floors(factor: int, width: int, kept: list[str]):
    top = largest(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            values = np.floor(matrix(column(batch, "v")).astype(np.float64) * factor)
            q = np.clip(values, -top, top).astype(np.int32)
            flat = pa.array(q.ravel(), pa.int32())
            ends = pa.array(np.arange(len(q) + 1, dtype=np.int32) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.ListArray.from_arrays(ends, flat)], [*kept, "q"])

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, and none that is empty."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def common_width(rows: DataFrame) -> int:
    """The commonest length of the vectors ``v``, the longest of several; 0 if there are none."""
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k"))
    first = lengths.orderBy(F.desc("k"), F.desc("n")).first()
    return first["n"] if first else 0


def whole_vectors(vectors: DataFrame, kept: list[str]) -> DataFrame:
    """The kept expressions and embedding, as ``v``, of rows whose vector is neither null nor empty and all finite."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & sound).select(*map(F.expr, kept), v.alias("v"))


def integer_vectors(rows: DataFrame, factor: int, width: int, kept: dict[str, str]) -> DataFrame:
    """kept (name to type) and q, array<int> of floor(factor * x), of the rows of that width.

    Components beyond largest(width) are held there, so that every later sum is exact; that is
    8 million for 64 components, 8192 in units of a factor of 1024.
    """
    schema = ", ".join(f"{k} {t}" for k, t in kept.items()) + ", q array<int>"
    return rows.where(F.size("v") == width).mapInArrow(tidy(_floors(factor, width, list(kept))), schema)

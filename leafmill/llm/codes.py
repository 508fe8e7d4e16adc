"""Compression of vectors to codes by Lloyd's algorithm with Hamerly's bounds.

Vectors are cut into parts, and each part's codebook is learned apart.  A part keeps the
entry it is assigned to, one upper bound of its distance to it and one lower bound of its
distance to any other.  As entries move, the upper bound grows by its own entry's move and
the lower one shrinks by the largest of the others'.  While the upper bound is strictly
below the lower one, or below half the way from its entry to the nearest other, no other
entry can be as near, and the part isn't compared.  Otherwise its distance is computed anew;
only where that doesn't settle it either are all entries compared, in exact integers, ties
going to the lower index.  Bounds are held off by more than their rounding errors.

Each round reads and writes the table of parts once; sums travel only for parts that moved,
one row an entry and task.  What the driver holds is the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import column, removed, tidy, written
from leafmill.llm.vectors import common_width, integer_vectors, matrix, slices, whole_vectors

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024
#: Bounds must be apart by this share and amount, which is far above what rounding can do.
RELATIVE, ABSOLUTE = 1e-9, 1e-6
#: A label with more than this share of the rows is joined by broadcast; there are fewer than its inverse.
HOT_LABEL = 1 / 128
STATE = "vec_id bigint, label string, q array<int>, entry array<int>, was array<int>, upper array<double>, lower array<double>, error array<bigint>"


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Start and end of each part; where the width isn't a multiple, the first ones are longer by one."""
    size, more = divmod(width, parts)
    ends = np.cumsum([size + (k < more) for k in range(parts)])
    return [(int(e) - size - (k < more), int(e)) for k, e in enumerate(ends)]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as doubles: components are small enough (vectors.largest)."""
    x, entries = x.astype(np.float64), entries.astype(np.float64)
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


@dataclass
class Codebook:
    """A part's entries, how far each has just moved, and half the way to its nearest other."""

    entries: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Codebook:
        between = squares(entries, entries)
        np.fill_diagonal(between, np.inf)
        half = np.sqrt(between.min(1)) / 2 if len(entries) > 1 else np.full(1, np.inf)
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(1))
        return cls(entries, moved, half)

    def others_moved(self) -> np.ndarray:
        """For each entry, the largest move of any other."""
        if len(self.moved) < 2:
            return np.zeros(len(self.moved))
        order = np.argsort(self.moved)
        most = np.full(len(self.moved), self.moved[order[-1]])
        most[order[-1]] = self.moved[order[-2]]
        return most


def assign(x: np.ndarray, book: Codebook, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of the rows x, with bounds, squared errors (if exact) and the number of full scans.

    entry is -1 for rows that are new.  Errors of rows settled by bounds alone are computed only
    if exact.
    """
    entry, upper, lower = entry.copy(), upper.copy(), lower.copy()
    old = entry >= 0
    upper[old] = (upper[old] + book.moved[entry[old]]) * (1 + RELATIVE)
    lower[old] = np.maximum(lower[old] - book.others_moved()[entry[old]], 0) * (1 - RELATIVE)

    def unsettled(at: np.ndarray) -> np.ndarray:
        bound = np.maximum(lower[at], book.half[entry[at]])
        return at[~(upper[at] < bound * (1 - RELATIVE) - ABSOLUTE)]

    open_ = unsettled(np.flatnonzero(old))
    upper[open_] = np.sqrt(((x[open_] - book.entries[entry[open_]]).astype(np.float64) ** 2).sum(1))
    open_ = np.concatenate([unsettled(open_), np.flatnonzero(~old)])
    far = squares(x[open_], book.entries)
    best = far.argmin(1) if len(open_) else np.zeros(0, np.int64)  # the first of equals
    row = np.arange(len(open_))
    upper[open_] = np.sqrt(far[row, best])
    entry[open_] = best
    far[row, best] = np.inf
    lower[open_] = np.sqrt(far.min(1))
    error = np.zeros(len(x), np.int64)
    if exact:
        error = ((x - book.entries[entry]) ** 2).sum(1)
    return entry, upper, lower, error, len(open_)


def _round(books, parts: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            q = matrix(column(batch, "q"))
            old = {k: matrix(column(batch, k)) for k in ("entry", "upper", "lower")}
            new = [assign(q[:, s:e], b, *(old[k][:, p] for k in ("entry", "upper", "lower")), exact=last)[:4] for p, ((s, e), b) in enumerate(zip(cuts(q.shape[1], parts), books.value))]
            entry, upper, lower, error = (np.stack(x, 1) for x in zip(*new))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "vec_id"), column(batch, "label"), column(batch, "q"), *(_lists(x) for x in (entry.astype(np.int32), old["entry"].astype(np.int32), upper, lower, error))],
                ["vec_id", "label", "q", "entry", "was", "upper", "lower", "error"],
            )

    return run


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _moves(parts: int, entries: int, width: int):
    """What the parts that moved take from their old entries' sums and counts and add to their new ones'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = cuts(width, parts)
        sums = [np.zeros((entries, e - s), np.int64) for s, e in spans]
        counts = np.zeros((parts, entries), np.int64)
        touched = np.zeros((parts, entries), bool)
        for batch in slices(batches, 4096):
            q, new, was = (matrix(column(batch, k)) for k in ("q", "entry", "was"))
            for p, (s, e) in enumerate(spans):
                moved = new[:, p] != was[:, p]
                for to, sign, rows in ((new[:, p], 1, moved), (was[:, p], -1, moved & (was[:, p] >= 0))):
                    at, x = to[rows], q[rows, s:e].astype(np.int64)
                    if len(at):
                        order = np.argsort(at, kind="stable")
                        ids, starts, n = np.unique(at[order], return_index=True, return_counts=True)
                        sums[p][ids] += sign * np.add.reduceat(x[order], starts, axis=0)
                        counts[p, ids] += sign * n
                        touched[p, ids] = True
        part, entry = np.nonzero(touched)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array([sums[p][k].tolist() for p, k in zip(part, entry)], pa.list_(pa.int64()))],
                ["part", "entry", "count", "sums"],
            )

    return run


@dataclass
class Codes:
    rows: DataFrame
    codebooks: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all entries' components, by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> Codes:
    """Codes of vectors(vec_id, embedding, label): rows (vec_id, label, entry array<int>, error) and the codebooks.

    Null and empty vectors and those with null or non-finite components are left out, as are
    those of another length than the commonest.  The codebooks start as the parts of the rows
    with the smallest vec_id, null last, rows of one vec_id by their components; with fewer rows
    they have fewer entries.  Repeated rows count each on its own.  Rows without vec_id are coded
    like any other.  label may be of any type that casts to string, and null.  Other columns are
    ignored; an empty table gives no rows and empty codebooks.  Of entries that are equal the
    first is used, and the others stay.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, ["cast(vec_id as bigint) as vec_id", "cast(label as string) as label"])
    width = common_width(whole)
    if not width:
        return Codes(spark.createDataFrame([], "vec_id bigint, label string, entry array<int>, error bigint"), [])
    unset = lambda x, t: F.array_repeat(F.lit(x).cast(t), parts)
    fresh = integer_vectors(whole, factor, width, {"vec_id": "bigint", "label": "string"})
    state = written(fresh.select("*", unset(-1, "int").alias("entry"), unset(-1, "int").alias("was"), unset(0, "double").alias("upper"), unset(0, "double").alias("lower"), unset(0, "bigint").alias("error")), "codes")
    seeds = np.array([r.q for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()], np.int64)
    spans = cuts(width, parts)
    books = [Codebook.of(seeds[:, s:e]) for s, e in spans]
    sums, counts = [np.zeros_like(b.entries) for b in books], np.zeros((parts, len(seeds)), np.int64)
    for k in range(rounds + 1):
        sent = spark.sparkContext.broadcast(books)
        before, state = state, written(state.mapInArrow(tidy(_round(sent, parts, k == rounds)), STATE), "codes")
        removed(before)
        sent.unpersist()
        if k == rounds:
            break
        moved = state.where("entry <> was").select("q", "entry", "was").mapInArrow(tidy(_moves(parts, len(seeds), width)), "part int, entry int, count bigint, sums array<bigint>")
        each = moved.select("part", "entry", "count", F.posexplode("sums").alias("at", "x"))
        totals = each.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("count").alias("n"))
        for r in totals.collect():  # a row for each component of each entry
            sums[r["part"]][r["entry"], r["at"]] += r["x"]
            counts[r["part"], r["entry"]] += r["n"] if r["at"] == 0 else 0
        updated = []
        for p, book in enumerate(books):
            used = counts[p] > 0
            entries_now = book.entries.copy()
            entries_now[used] = sums[p][used] // counts[p][used, None]  # floor
            updated.append(Codebook.of(entries_now, book.entries))
        books = updated
    error = F.aggregate("error", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return Codes(state.select("vec_id", "label", "entry", error.alias("error")), [b.entries for b in books])


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of errors of the rows of an equal label, nulls being one label.

    A label of many rows is joined by broadcast, at most 1 / HOT_LABEL of them; others by their key.
    """
    totals = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    n = totals.agg(F.sum("n")).first()[0] or 0
    hot, cold = totals.where(F.col("n") > n * HOT_LABEL), totals.where(F.col("n") <= n * HOT_LABEL)

    def joined(part: DataFrame) -> DataFrame:
        t = part.select(F.col("label").alias("__label"), "label_error")
        return rows.join(t, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")

    return joined(F.broadcast(hot)).unionByName(joined(cold.hint("shuffle_hash")))

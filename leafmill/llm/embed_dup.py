"""Embedding near-duplicates by tiles of int8 products with rigorous error bounds.

A unit vector x is kept as scale * q with int8 codes q and the exact norm e of what that
loses.  For two of them |x.y - sx*sy*(qx.qy)| <= ex + ey + ex*ey, so only pairs whose
code product comes within the bound of the threshold are computed again in double
precision.  Equal vectors are one row with a count.  Vectors are ordered into tiles by
random hyperplane codes; pairs of tiles whose centroids are farther apart than the
threshold angle and both radii are left out, which is exact by the triangle inequality.
Neighbouring tiles form groups of bounded size, and a pair of groups travels together, so
that a vector is sent once for each group it meets and not once for each tile.  A task
returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import column, tidy, written
from leafmill.llm.graph import components, roots

TILE = 2048
#: Bytes of a group's vectors in double precision; a task holds two groups.
GROUP = 32 << 20
#: Links of a group pair that are kept before they are contracted.
HELD = 1 << 18


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """Finite, non-zero vectors of a batch, None for others."""
    lists = column(batch, "embedding")
    flat = lists.flatten()
    bad = np.asarray(flat.is_null().to_numpy(zero_copy_only=False))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    values[bad] = np.nan
    ends = np.cumsum(np.array([n or 0 for n in lists.value_lengths().to_pylist()], dtype=np.int64)) if len(lists) else np.zeros(0, int)
    out, start = [], 0
    for ok, e in zip(lists.is_valid().to_pylist(), ends):
        v = values[start:e]
        start = e
        out.append(v + 0.0 if ok and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and norms of the error, of unit rows."""
    scale = np.maximum(np.abs(x).max(1), 1e-30) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-12


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes; float32 holds sums of 1024 of them exactly."""
    total = 0.0
    for k in range(0, a.shape[1], 1024):
        total = total + (a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T)
    return total


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows of x and y at the threshold or above; of one tile, each pair once."""
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    found_i, found_j = [], []
    for s in range(0, len(x), 512):
        near = code_products(qx[s : s + 512], qy) * sx[s : s + 512, None] * sy
        near += ex[s : s + 512, None] * (1 + ey) + ey
        i, j = np.nonzero(near >= threshold - 1e-9)
        if same:
            above = s + i < j
            i, j = i[above], j[above]
        for t in range(0, len(i), 1 << 17):
            a, b = s + i[t : t + (1 << 17)], j[t : t + (1 << 17)]
            sure = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            found_i.append(a[sure])
            found_j.append(b[sure])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def _prepare(single: bool):
    """Vectors with a digest each, in single precision where they came so, which loses nothing."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch)
            digest = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors]
            kept = pa.array([None if v is None else v.astype(kind) for v in vectors], pa.list_(pa.from_numpy_dtype(kind)))
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(digest, pa.binary()), kept], ["vec_id", "digest", "v"])

    return run


def _place(bits: int):
    """Tile code of each vector: signs of products with fixed random directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            code, dims = [], []
            for v in (np.array(x, dtype=np.float64) for x in column(batch, "v").to_pylist()):
                n = len(v)
                if n not in planes:
                    planes[n] = np.random.default_rng(29).standard_normal((bits, n))
                code.append(int(((planes[n] @ v > 0) << np.arange(bits)).sum()))
                dims.append(n)
            yield pa.RecordBatch.from_arrays([column(batch, "rep"), column(batch, "copies"), column(batch, "v"), pa.array(dims, pa.int32()), pa.array(code, pa.int64())], ["rep", "copies", "v", "dims", "code"])

    return run


def _unit_rows(batch: pa.RecordBatch) -> np.ndarray:
    lists = column(batch, "v")
    x = lists.flatten().to_numpy().reshape(len(lists), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key as one batch; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = column(batch, key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                if held and column(held[0], key)[0].as_py() != keys[s]:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sphere(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Direction and angle of a cone that holds the unit rows of x."""
    centre = x.mean(0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 1e-9 else np.eye(1, x.shape[1])[0]
    return centre, float(np.arccos(np.clip(x @ centre, -1, 1)).max()) + 1e-7


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches, "tile"):
        x = _unit_rows(rows)
        centre, radius = _sphere(x)
        columns = [column(rows, c).slice(0, 1) for c in ("tile", "code")]
        columns += [pa.array([x.shape[1]], pa.int32()), pa.array([x.size * 8], pa.int64()), pa.array([radius]), pa.array([centre.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["tile", "code", "dims", "bytes", "radius", "centre"])


def _near(one: tuple[np.ndarray, float], other: tuple[np.ndarray, float], threshold: float) -> bool:
    """Whether rows in two cones may reach the threshold."""
    return len(one[0]) == len(other[0]) and math.acos(np.clip(one[0] @ other[0], -1, 1)) - one[1] - other[1] <= math.acos(threshold) + 1e-6


def _compare(threshold: float):
    """Of each pair of groups, or group by itself, the links by vector and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "unit"):
            tile, side, ids, copies = (column(rows, c).to_numpy() for c in ("tile", "side", "rep", "copies"))
            cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1), len(tile)]
            tiles = [(s, side[s], x := _unit_rows(rows.slice(s, e - s)), _sphere(x)) for s, e in zip(cuts, cuts[1:])]
            two = side.min() != side.max()
            links, held = np.zeros(len(ids), dtype=np.int64), []
            for k, (s, of, x, cone) in enumerate(tiles):
                for t, of2, y, cone2 in tiles[k:]:
                    if (two and of == of2) or (s != t and not _near(cone, cone2, threshold)):
                        continue
                    i, j = tile_links(x, y, s == t, threshold)
                    if not len(i):
                        continue
                    i, j = s + i, t + j
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    held.append(_forest(i, j))
                    if sum(len(h[0]) for h in held) > HELD:
                        held = [_forest(*map(np.concatenate, zip(*held)))]
            has = np.flatnonzero(links)
            root = np.arange(len(ids))
            if held:
                a, b = _forest(*map(np.concatenate, zip(*held)))
                root[a] = b
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has]), pa.array(ids[root[has]])], ["rep", "links", "root"])

    return run


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links i-j as stars: each node that isn't its component's smallest, with that."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    label = nodes[roots(len(nodes), at[: len(i)], at[len(i) :])]
    off = label != nodes
    return nodes[off], label[off]


def paired(bounds: DataFrame, threshold: float) -> DataFrame:
    """(unit, tile, side): the tiles that meet for each pair of groups, or group by itself, with each tile's group.

    There is a row for each tile in bounds; groups are neighbours, at least sixteen where there are as many tiles.
    """
    upto = F.sum("bytes").over(Window.orderBy("dims", "code", "tile").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    bounds = written(bounds.withColumn("side", F.floor((upto - F.col("bytes")) / F.least(F.lit(GROUP), total / 16))), "sides")
    other = bounds.select("dims", *(F.col(c).alias(f"{c}2") for c in ("tile", "side", "radius", "centre")))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("centre", "centre2", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))))
    pairs = bounds.join(other, "dims").where("tile <= tile2").where((F.col("tile") == F.col("tile2")) | (apart - F.col("radius") - F.col("radius2") <= math.acos(threshold) + 1e-6))
    unit = F.least("side", "side2") * F.lit(1 << 31) + F.greatest("side", "side2")
    ends = F.array(F.struct("tile", "side"), F.struct(F.col("tile2").alias("tile"), F.col("side2").alias("side")))
    return pairs.select(unit.alias("unit"), F.explode(ends).alias("end")).select("unit", "end.tile", "end.side").distinct()


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors needs vec_id (long) and embedding (array of float or double).  Null, empty and
    zero vectors, and those with null or non-finite components, link with nothing; vectors of
    different lengths aren't compared.  Rows without vec_id are left out; other columns are
    ignored; an empty table gives no rows.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    named = written(rows.mapInArrow(tidy(_prepare(single)), f"vec_id long, digest binary, v {kind}"), "vectors")
    groups = named.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    groups = written(groups, "groups")
    n = groups.count()
    bits = min(20, max(1, math.ceil(math.log2(max(2, n / TILE)))))
    reps = named.join(groups.select("rep", "copies", F.col("digest").alias("d")), (F.col("vec_id") == F.col("rep")) & (F.col("digest") == F.col("d")))
    reps = reps.select("rep", "copies", "v").dropDuplicates(["rep"])
    placed = written(reps.mapInArrow(tidy(_place(bits)), f"rep long, copies long, v {kind}, dims int, code long"), "placed")
    parts = placed.groupBy("dims", "code").agg(F.ceil(F.count("*") / F.lit(float(TILE))).cast("int").alias("parts"))
    tiled = placed.join(parts, ["dims", "code"]).withColumn("tile", F.xxhash64("dims", "code", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    tiled = written(tiled.select("tile", "code", "rep", "copies", "v"), "tiled")
    bounds = tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidy(_bounds), "tile long, code long, dims int, bytes long, radius double, centre array<double>")
    ends = paired(written(bounds, "bounds"), threshold)
    units = tiled.join(ends, "tile").repartition("unit").sortWithinPartitions("unit", "side", "tile", "rep")
    found = written(units.select("unit", "tile", "side", "rep", "copies", "v").mapInArrow(tidy(_compare(threshold)), "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.select("rep", "root")).withColumnRenamed("id", "rep")
    per_group = groups.join(links, "rep", "left").join(classes, "rep", "left").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    result = named.select("vec_id", "digest").join(per_group, "digest", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return result.withColumn("kept", F.col("vec_id") == F.col("component_id"))

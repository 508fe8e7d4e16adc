"""MinHash near-duplicate classes with SetSketch registers.

Each document's set of distinct word shingles gets ``bands * rows`` registers.  A
register is the truncated base-``BASE`` exponent of the smallest exponential variate
over the set, so sketches of parts merge by maximum and equal registers indicate
overlap.  Groups of ``rows`` registers are band keys; documents sharing a band key form
candidate clusters, found as connected components of (smallest id in bucket, id) links.
A cluster is cut into tiles of bounded size; for each pair of tiles that share a band key
the similarity of all pairs is estimated by maximum likelihood from the joint register
comparison (less, equal, greater) and the two set sizes, and what may reach the threshold
is confirmed on the full sets.  A task returns a spanning forest of its confirmed links,
never the pairs.

With 40 bands of 5 rows a pair at similarity 0.75 shares no key with probability 2e-5.
Texts with equal sets are one class from the start: a group of copies costs one row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import chunks, column, tidy, utf8, written
from leafmill.llm.graph import components, roots
from leafmill.llm.textkernels import mix, shingle_sets

#: Base of the registers' exponents and the largest exponent kept.
BASE, TOP = 1.02, 65534
#: Standard deviations by which an estimate may miss before a pair is dropped unverified.
SLACK = 4.5
#: Documents and characters that a tile holds, about.
TILE_ROWS, TILE_CHARS = 256, 2_000_000


def registers(hashes: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers (texts x m, uint16) of sets given as concatenated hashes; 0 for empty sets."""
    out = np.zeros((len(counts), m), dtype=np.uint16)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    seeds = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    flip, factor = seeds[:m].astype(np.uint32), seeds[m:].astype(np.uint32) | np.uint32(1)
    low = np.full((len(full), m), 0xFFFFFFFF, dtype=np.uint32)
    ends = np.cumsum(counts[full])
    begin, at = ends - counts[full], 0
    h32 = (hashes >> np.uint64(32)).astype(np.uint32)
    while at < len(full):
        stop = max(at + 1, int(np.searchsorted(ends, begin[at] + 65536, side="right")))
        part = h32[begin[at] : ends[stop - 1]]
        cuts = begin[at:stop] - begin[at]
        work = np.empty_like(part)
        for k in range(m):
            np.bitwise_xor(part, flip[k], out=work)
            np.multiply(work, factor[k], out=work)
            low[at:stop, k] = np.minimum.reduceat(work, cuts)
        at = stop
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 4294967296.0)
    exponent = np.floor(1 - np.log(least) / math.log(BASE)) + 600
    out[full] = np.clip(exponent, 0, TOP + 1).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys (texts x bands) of the register groups."""
    key = np.zeros((len(regs), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    parts = regs.reshape(len(regs), bands, rows).astype(np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def likely_similarity(less: np.ndarray, more: np.ndarray, m: int, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and exact set sizes."""
    u = n1 / (n1 + n2)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    lo, hi = np.zeros_like(top), top
    scale = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * scale) / math.log(BASE)

    def value(j):
        a, b = p(u - v * j), p(v - u * j)
        return less * np.log(np.maximum(b, 1e-12)) + more * np.log(np.maximum(a, 1e-12)) + (m - less - more) * np.log(
            np.maximum(1 - a - b, 1e-12)
        )

    for _ in range(26):
        x, y = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = value(x) > value(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def _sketch(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            texts = [t or b"" for t in utf8(column(part, "text"))]
            hashes, counts = shingle_sets(texts, width)
            keys = band_keys(registers(hashes, counts, bands * rows), bands, rows).view(np.int64)
            ends = np.cumsum(counts)
            digest = [hashlib.blake2b(hashes[e - n : e].tobytes(), digest_size=16).digest() for e, n in zip(ends, counts)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(counts), pa.array(digest, pa.binary()), lists],
                ["doc_id", "n_shingles", "digest", "keys"],
            )

    return run


def _confirm(threshold: float, m: int, width: int):
    """Links of one work unit: rows (unit, cluster, tile, doc_id, text), sorted by unit."""
    num = round(threshold * 100)

    def unit(cluster: np.ndarray, tile: np.ndarray, ids: np.ndarray, texts: list[bytes]):
        hashes, n = shingle_sets(texts, width)
        ends = np.cumsum(n)
        sets = [hashes[e - k : e] for e, k in zip(ends, n)]
        regs = registers(hashes, n, m)
        label = np.arange(len(ids))

        def top(i):
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        one = len(np.unique(tile)) < 2
        order = np.argsort(cluster, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            for s in range(0, len(group), 256):
                rows = group[s : s + 256]
                for t in range(s, len(group), 256):
                    cols = group[t : t + 256]
                    less = np.zeros((len(rows), len(cols)), np.int32)
                    more = np.zeros_like(less)
                    for i, r in enumerate(rows):
                        other = regs[cols]
                        less[i] = (regs[r] < other).sum(1)
                        more[i] = (regs[r] > other).sum(1)
                    n1, n2 = n[rows][:, None], n[cols][None, :]
                    fit = (np.minimum(n1, n2) * 100 >= num * np.maximum(n1, n2)) & (rows[:, None] != cols[None, :])
                    if s == t:
                        fit &= np.arange(len(rows))[:, None] < np.arange(len(cols))[None, :]
                    if not one:
                        fit &= (tile[rows][:, None] != tile[cols][None, :])
                    # At the threshold the equal registers are below half of all with probability under 1e-12.
                    fit &= 2 * (less + more) <= m
                    i, j = np.nonzero(fit)
                    if not len(i):
                        continue
                    est = likely_similarity(less[i, j], more[i, j], m, n[rows[i]].astype(float), n[cols[j]].astype(float))
                    keep = est >= threshold - SLACK * math.sqrt(threshold * (1 - threshold) / m)
                    i, j, est = i[keep], j[keep], est[keep]
                    for k in np.argsort(-est, kind="stable"):
                        a, b = rows[i[k]], cols[j[k]]
                        ra, rb = top(a), top(b)
                        if ra == rb:
                            continue
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * both >= num * (n[a] + n[b] - both):
                            label[max(ra, rb)] = min(ra, rb)
        final = np.array([top(i) for i in range(len(ids))])
        off = final != np.arange(len(ids))
        return ids[off], ids[final[off]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held)
            texts = [t for c in table.column("text").chunks for t in utf8(c)]
            a, b = unit(*(table.column(k).to_numpy() for k in ("cluster", "tile", "doc_id")), texts)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = column(batch, "unit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    if held and column(held[-1], "unit")[0].as_py() != keys[s]:
                        yield flush()
                    held.append(batch.slice(s, e - s))
        if held:
            yield flush()

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.75, width: int = 5, bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs needs doc_id (long, unique) and text.  Null and empty texts have an empty set, are
    linked with nothing and are kept.  Repeated rows of one doc_id give one row each with the
    same class.  Rows without doc_id are left out; other columns are ignored; an empty table
    gives an empty result.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(
        docs.mapInArrow(tidy(_sketch(bands, rows, width)), "doc_id long, n_shingles long, digest binary, keys array<long>"),
        "sketch",
    )
    full = sketch.where("n_shingles > 0")
    reps = full.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"))
    rep_keys = full.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    hits = rep_keys.select("doc_id", F.explode("keys").alias("key"))
    shared = hits.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    hits = written(hits.join(shared.select("key", "first"), "key"), "hits")
    clusters = written(components(hits.where("first <> doc_id").select("first", "doc_id").distinct()), "clusters")
    links = _links(docs, hits, clusters, threshold, bands * rows, width)
    classes = components(links).withColumnRenamed("id", "rep")
    named = sketch.join(reps, ["digest", "n_shingles"], "left").join(classes, "rep", "left")
    result = named.select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")
    )
    return result.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _links(docs: DataFrame, hits: DataFrame, clusters: DataFrame, threshold: float, m: int, width: int) -> DataFrame:
    members = clusters.join(
        docs.where("text is not null").withColumnRenamed("doc_id", "id").dropDuplicates(["id"]), "id"
    ).select("id", "component", "text", F.length("text").alias("chars"))
    members = written(members, "members")
    size = members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))
    size = size.select(
        "component",
        F.ceil(F.greatest(F.col("docs") / F.lit(float(TILE_ROWS)), F.col("chars") / F.lit(float(TILE_CHARS)))).cast("int").alias("tiles"),
        "docs",
    )
    total = size.agg(F.sum("docs")).first()[0] or 0
    packs = max(1, math.ceil(total / TILE_ROWS))
    placed = (
        members.join(size, "component")
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        .select("id", "component", "tiles", "tile", "text")
    )
    small = placed.where("tiles = 1").select(
        F.pmod(F.xxhash64("component"), F.lit(packs)).alias("unit"), F.col("component").alias("cluster"), "tile", F.col("id").alias("doc_id"), "text"
    )
    # Of a cluster with several tiles: the pairs of tiles that share a band key.
    big = size.where("tiles > 1").select("component", "tiles")
    where = hits.join(clusters.withColumnRenamed("id", "doc_id"), "doc_id").join(big, "component")
    where = where.select("key", "component", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int").alias("tile")).distinct()
    pairs = (
        where.join(where.select("key", F.col("tile").alias("other")), "key")
        .where("tile <= other")
        .select("component", "tile", "other")
        .distinct()
    )
    ends = pairs.withColumn("part", F.explode(F.array_distinct(F.array("tile", "other"))))
    large = (
        placed.where("tiles > 1")
        .withColumnRenamed("tile", "part")
        .join(ends, ["component", "part"])
        .select(
            F.xxhash64("component", "tile", "other").alias("unit"),
            F.col("component").alias("cluster"),
            F.col("part").alias("tile"),
            F.col("id").alias("doc_id"),
            "text",
        )
    )
    units = small.unionByName(large)
    units = units.repartition("unit").sortWithinPartitions("unit", "cluster", "tile", "doc_id")
    return units.mapInArrow(tidy(_confirm(threshold, m, width)), "a long, b long")


def exact_links(sets: list[set], threshold: float = 0.75) -> np.ndarray:
    """Brute force for tests: the smallest index that each set reaches."""
    num, a, b = round(threshold * 100), [], []
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= num * (len(x) + len(sets[j]) - both):
                a.append(i)
                b.append(j)
    return roots(len(sets), np.array(a, int), np.array(b, int))

"""Joins between captures, pages and caches, and small entity resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import squash
from leafmill.sources.shared import kept


def capture_key() -> Column:
    """A capture's identity, which outlives renumbering."""
    return F.coalesce("patched_source", "canonical")


def restore_cached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages with text and cached from cache(capture, text) by capture identity."""
    return pages.withColumn("capture", capture_key()).join(cache, "capture", "left").withColumn("cached", F.col("text").isNotNull())


def first_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each old(id, frames) the first new(id, frames) by id that shares a frame, null if none: id, match."""
    a = old.select("id", F.explode("frames").alias("f"))
    b = new.select(F.col("id").alias("match"), F.explode("frames").alias("f"))
    hits = a.join(b, "f").groupBy("id").agg(F.min("match").alias("match"))
    return old.select("id").join(hits, "id", "left")


def hamming(a: str, b: str) -> Column:
    """Differing bits of two 16-digit hex hashes."""

    def half(c: str, at: int) -> Column:
        return F.conv(F.substring(c, at, 8), 16, 10).cast("long")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def sign_hash(vector: str) -> Column:
    """16 hex digits: bit k, most significant first, says whether component k exceeds the median of all but the first."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    middle = F.element_at(F.array_sort(F.slice(v, 2, F.size(v) - 1)), 32)
    # The median is found once a row, not once for each component.
    once = lambda m: F.lower(F.concat(*(F.lpad(F.conv(F.array_join(F.transform(F.slice(v, s, 32), lambda x: F.when(x > m, "1").otherwise("0")), ""), 2, 16), 8, "0") for s in (1, 33))))
    return F.get(F.transform(F.array(middle), once), 0)


#: Hashes of one label that are compared in one group at most; more are cut into tiles.
TILE = 4096


def hash_bits(c: Column) -> Column:
    """A hash of 16 hex digits as one number of 64 bits."""
    half = lambda at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hamming_pairs(hashes: DataFrame, most: int = 20) -> DataFrame:
    """Pairs id_a < id_b of one label whose hashes differ in at most most bits.

    Hashes become numbers once.  A label's are dealt to tiles, and each pair of tiles is a group
    of its own, so a label that holds most rows is many tasks; a pair of rows meets once.
    """
    tiles = hashes.groupBy("label").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    rows = hashes.join(tiles, "label").select("label", "id", hash_bits(F.col("hash")).alias("bits"), F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"), "tiles")
    a = rows.select("label", F.col("tile").alias("ta"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tb"), F.col("id").alias("a"), F.col("bits").alias("bits_a"))
    b = rows.select("label", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("ta"), F.col("tile").alias("tb"), F.col("id").alias("b"), F.col("bits").alias("bits_b"))
    pairs = a.join(b, ["label", "ta", "tb"]).where((F.col("ta") < F.col("tb")) | (F.col("a") < F.col("b")))
    pairs = pairs.withColumn("distance", F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))).where(F.col("distance") <= most)
    return pairs.where("a <> b").select("label", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "distance")


def _near_bits(most: int):
    """Pairs within most bits of two tiles, or of one with itself; rows of b in blocks, so that no table of all pairs is made."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a_id, a_bits, b_id, b_bits = (x.to_numpy() for x in (a["a"], a["bits_a"], b["b"], b["bits_b"]))
        found = []
        for s in range(0, len(b_id), 256):
            far = np.bitwise_count((a_bits[:, None] ^ b_bits[None, s : s + 256]).view(np.uint64))
            i, k = np.nonzero(far <= most)
            one, two = a_id[i], b_id[s + k]
            kept_ = one < two if key[1] == key[2] else one != two
            found.append(pd.DataFrame({"label": key[0], "id_a": np.minimum(one, two)[kept_], "id_b": np.maximum(one, two)[kept_]}))
        return pd.concat(found) if found else pd.DataFrame({"label": [], "id_a": [], "id_b": []})

    return run


def near_hashes(hashes: DataFrame, most: int) -> DataFrame:
    """label, id_a, id_b of pairs id_a < id_b of one label within most bits, of hashes(label, id, bits), ids being long.

    All pairs are compared, tile by tile as in hamming_pairs, whole arrays at a time.
    """
    tiles = hashes.groupBy("label").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    rows = hashes.join(tiles, "label").select("label", "id", "bits", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"), "tiles")
    a = rows.select(F.col("label").alias("la"), F.col("tile").alias("ta"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tb"), F.col("id").alias("a"), F.col("bits").alias("bits_a"))
    b = rows.select(F.col("label").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("ta"), F.col("tile").alias("tb"), F.col("id").alias("b"), F.col("bits").alias("bits_b"))
    return a.groupBy("la", "ta", "tb").cogroup(b.groupBy("lb", "ta", "tb")).applyInPandas(_near_bits(most), f"label {hashes.schema['label'].dataType.simpleString()}, id_a long, id_b long")


def majority_hash(hashes: DataFrame) -> DataFrame:
    """label, hash: each bit set in over half of the label's hashes."""
    digit = F.conv(F.substring("hash", F.col("d"), 1), 16, 10).cast("int")
    rows = hashes.select("label", "hash", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("d")).withColumn("v", digit)
    bit = lambda k: F.when(F.sum((F.floor(F.col("v") / k) % 2).cast("int")) * 2 > F.count("*"), k).otherwise(0)
    digits = rows.groupBy("label", "d").agg((bit(8) + bit(4) + bit(2) + bit(1)).alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("d", F.lower(F.hex(F.col("v").cast("long"))).alias("h"))))
    return digits.groupBy("label").agg(F.array_join(F.transform(listed, lambda x: x["h"]), "").alias("hash"))


def iou(a: str = "a", b: str = "b") -> Column:
    """Intersection over union of boxes (a_x0, a_y0, a_x1, a_y1) and b's; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"{a}_{hi}", f"{b}_{hi}") - F.greatest(f"{a}_{lo}", f"{b}_{lo}"))
    inter = side("x0", "x1") * side("y0", "y1")
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def box_pairs(boxes: DataFrame, least: float = 0.05) -> DataFrame:
    """Overlapping boxes of one page: page, box_a < box_b, iou above least."""
    corners = ("x0", "y0", "x1", "y1")
    a = boxes.select("page", F.col("box").alias("box_a"), *(F.col(c).alias(f"a_{c}") for c in corners))
    b = boxes.select("page", F.col("box").alias("box_b"), *(F.col(c).alias(f"b_{c}") for c in corners))
    pairs = a.join(b, "page").where("box_a < box_b").withColumn("iou", iou())
    return pairs.where(F.col("iou") > least).select("page", "box_a", "box_b", "iou")


#: Snippets meet pages by their first GRAMS characters, the most that they have.
GRAMS = (24, 12)
#: A filter of the snippets' keys has 32 bits for each, and between these numbers of them (powers of two) in all.
LEAST_BITS, MOST_BITS = 15, 28
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _key(hashes: np.ndarray, group: np.ndarray | np.uint64, gram: int) -> np.ndarray:
    mixed = (hashes ^ group) * _MIX + np.uint64(gram)
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _windows(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram characters in a row."""
    n = max(0, len(codes) - gram + 1)
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total = total * _MIX + codes[k : k + n]
    return total


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys >> np.uint64(64 - bits), keys & np.uint64((1 << bits) - 1)


def _snippet_keys(by: list[str], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("__group").to_numpy().view(np.uint64)
            keys = np.zeros(len(groups), np.uint64)
            for i, t in enumerate(batch.column("target").to_pylist()):
                gram = next(g for g in GRAMS if len(t) >= g)
                keys[i : i + 1] = _key(_windows(np.frombuffer(t[:gram].encode(), np.uint8), gram), groups[i], gram)
            first, second = (pa.array(p.view(np.int64)) for p in _probes(keys, bits))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "target")), pa.array(keys.view(np.int64)), first, second], [*by, "target", "key", "first", "second"])

    return run


def _page_keys(by: list[str], bits: int, held):
    """The keys of each page's windows that the filter lets pass, each once a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(held.value, np.uint8)
        for whole in batches:
            for batch in (whole.slice(s, 512) for s in range(0, whole.num_rows, 512)):
                bodies = [x.encode() for x in batch.column("body").to_pylist()]
                ends = np.cumsum([len(x) for x in bodies])
                codes = np.frombuffer(b"".join(bodies), np.uint8)
                groups = batch.column("__group").to_numpy().view(np.uint64)
                for s in range(0, len(codes), 1 << 19):
                    for gram in GRAMS:
                        hashes = _windows(codes[s : s + (1 << 19) + gram - 1], gram)
                        start = s + np.arange(len(hashes))
                        page = np.searchsorted(ends, start, side="right")
                        inside = start + gram <= ends[page]
                        page = page[inside]
                        keys = _key(hashes[inside], groups[page], gram)
                        one, two = _probes(keys, bits)
                        ok = (filter_[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & (filter_[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        found = pd.DataFrame({"page": page[ok], "key": keys[ok].view(np.int64)}).drop_duplicates()
                        rows = batch.select([*by, "page_ord"]).take(pa.array(found["page"].to_numpy()))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found["key"].to_numpy())], [*by, "page_ord", "key"])

    return run


def candidate_pages(targets: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """by, target, page_ord: the pages of which a window has the key of a target's beginning; few are wrong, none is missed.

    targets(by, target) are distinct, of 12 characters or more; pages are (by, page_ord, body).
    """
    spark = targets.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * targets.count()).bit_length()))
    group = F.xxhash64(F.lit(0), *by).alias("__group")
    types = lambda df, names: "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in names)
    keys = targets.select(*by, "target", group).mapInArrow(_snippet_keys(by, bits), types(targets, by) + "target string, key long, first long, second long")
    each = keys.select(F.explode(F.array("first", "second")).alias("v"))
    cut = each.groupBy(F.expr("v div 32768").alias("n")).agg(F.bitmap_construct_agg(F.col("v") % 32768).alias("bitmap"))
    flags = bytearray(1 << (bits - 3))
    for row in cut.toLocalIterator():
        flags[row.n * 4096 : row.n * 4096 + 4096] = row.bitmap
    held = spark.sparkContext.broadcast(bytes(flags))
    windows = pages.where("body <> ''").select(*by, "page_ord", group, "body").mapInArrow(_page_keys(by, bits, held), types(pages, [*by, "page_ord"]) + "key long")
    return windows.join(keys.select(*by, "target", "key"), [*by, "key"]).select(*by, "target", "page_ord")


def first_containing(snippets: DataFrame, pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """snippet_id, page_ord (and by): the first page whose squashed text holds the snippet's first 160 characters.

    Snippets of under 12 characters match nothing; those of a group in by look at its pages only.
    Every window of a page is hashed where the page lies; only those travel that a filter of the
    snippets' first 24 or 12 characters lets pass.  A page then takes all snippets that its windows
    name, and its text is compared with these.  The filter is a bitmap of at most 32 MB.
    """
    by = by or []
    # Equal snippets are looked for once.
    all_ = kept(snippets.select(*by, "snippet_id", F.substring(squash(F.col("text")), 1, 160).alias("target")).where(F.length("target") >= 12))
    p = pages.select(*by, "page_ord", squash(F.col("text")).alias("body"))
    pairs = candidate_pages(all_.select(*by, "target").distinct(), p, by)
    named = pairs.groupBy(*by, "page_ord").agg(F.collect_set("target").alias("targets"))
    there = named.join(p, [*by, "page_ord"]).select(*by, "page_ord", F.explode(F.filter("targets", lambda t: F.contains("body", t))).alias("target"))
    first = there.groupBy(*by, "target").agg(F.min("page_ord").alias("page_ord"))
    return all_.join(first, [*by, "target"]).select(*by, "snippet_id", "page_ord")


def toc_to_page(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Each entry (book_id, title, number) with the first page of its number: page_ord, null if none."""
    w = Window.partitionBy("book_id", "printed_number").orderBy("page_ord")
    first = pages.where("printed_number is not null").withColumn("r", F.row_number().over(w)).where("r = 1")
    first = first.select("book_id", F.col("printed_number").alias("number"), "page_ord")
    return toc.join(first, ["book_id", "number"], "left")


def capture_sequence(pages: DataFrame, videos: DataFrame) -> DataFrame:
    """The videos' pages one after the other, those of reversed videos (video, direction) backwards: new_ord."""
    w = Window.partitionBy("book_id").orderBy("video", F.when(F.col("direction") == "reverse", -F.col("frame_no")).otherwise(F.col("frame_no")))
    return pages.join(videos, "video", "left").withColumn("new_ord", F.row_number().over(w))


def split_spreads(pages: DataFrame) -> DataFrame:
    """Two rows for each page with spread: left and right, in reading order of the direction; others stay."""
    sides = F.when(F.col("spread"), F.when(F.col("reverse"), F.array(F.lit("right"), F.lit("left"))).otherwise(F.array(F.lit("left"), F.lit("right")))).otherwise(F.array(F.lit(None).cast("string")))
    return pages.select(*pages.columns, F.posexplode(sides).alias("spread_order", "side")).withColumn(
        "id", F.when(F.col("side") == "right", F.concat("id", F.lit("r"))).otherwise(F.col("id"))
    )


#: The map that changes nothing, row by row.
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def _times(a: Column, b: Column) -> Column:
    """Product of two 3 x 3 matrices, row by row."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def _inverse(m: Column) -> Column:
    """What undoes a projective map, up to a factor, which doesn't matter to it."""
    minor = lambda i, j: m[3 * ((i + 1) % 3) + (j + 1) % 3] * m[3 * ((i + 2) % 3) + (j + 2) % 3] - m[3 * ((i + 1) % 3) + (j + 2) % 3] * m[3 * ((i + 2) % 3) + (j + 1) % 3]
    raw = F.array(*(minor(j, i) for i in range(3) for j in range(3)))
    # Scaled by a power of two, which loses nothing, so that long chains stay within range.
    power = lambda r: F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(r, F.abs)))))
    sized = F.transform(F.array(raw), lambda r: F.struct(r.alias("r"), power(r).alias("by")))
    return F.get(F.transform(sized, lambda s: F.transform(s["r"], lambda x: x / s["by"])), 0)


_FOLDED = "struct<matrix:array<double>,clips:array<struct<matrix:array<double>,w:double,h:double>>>"


def folded_steps(steps: DataFrame) -> DataFrame:
    """page, matrix, clips: the chain of steps(page, pos, kind, matrix, w, h) of each page as one map back to its source.

    homography steps map a page's image onward, by pos; a clip is a boundary that points pass on
    their way back.  matrix takes output points to the source; clips has each boundary with the
    map that takes output points to where it applies.  A page's steps are few and fold in order.
    """
    undone = F.when(F.col("kind") == "homography", _inverse(F.col("matrix")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("back"), "kind", "undone", "w", "h")))
    one = F.array(*map(F.lit, IDENTITY))

    def step(s: Column, x: Column) -> Column:
        clip = F.struct(s["matrix"].alias("matrix"), x["w"].alias("w"), x["h"].alias("h"))
        onward = F.when(x["kind"] == "homography", _times(x["undone"], s["matrix"])).otherwise(s["matrix"])
        return F.struct(onward.alias("matrix"), F.when(x["kind"] == "clip", F.concat(s["clips"], F.array(clip))).otherwise(s["clips"]).alias("clips")).cast(_FOLDED)

    start = F.struct(one.alias("matrix"), F.array().alias("clips")).cast(_FOLDED)
    return steps.withColumn("undone", undone).groupBy("page").agg(F.aggregate(listed, start, step).alias("x")).select("page", "x.matrix", "x.clips")


def _mapped(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    over = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / over, (m[3] * x + m[4] * y + m[5]) / over


def source_points(points: DataFrame, steps: DataFrame) -> DataFrame:
    """points(page, x, y) with source_x, source_y and margin, mapped once through the whole chain.

    margin is how far inside the nearest boundary a point is, negative outside, and a million
    where there is none; points of pages without steps are their own source.
    """
    rows = points.join(folded_steps(steps), "page", "left")
    m = F.coalesce("matrix", F.array(*map(F.lit, IDENTITY)))
    x, y = _mapped(m, F.col("x"), F.col("y"))

    def inside(c: Column) -> Column:
        cx, cy = _mapped(c["matrix"], F.col("x"), F.col("y"))
        return F.least(cx + 0.5, c["w"] - 0.5 - cx, cy + 0.5, c["h"] - 0.5 - cy)

    margins = F.transform(F.coalesce("clips", F.array().cast("array<struct<matrix:array<double>,w:double,h:double>>")), inside)
    margin = F.least(F.coalesce(F.array_min(margins), F.lit(1e6)), F.lit(1e6))
    return rows.withColumns({"source_x": x, "source_y": y, "margin": margin}).drop("matrix", "clips")

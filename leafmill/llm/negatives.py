"""Hard-negative mining by a Voronoi-partitioned nearest-neighbour join on integer inner products.

With M the largest norm, a row x gets a further component sqrt(M^2 - |x|^2) and an anchor a
further 0; then |a - x|^2 = |a|^2 + M^2 - 2 a.x, and high inner products are short distances.
Rows go to the cell of their nearest pivot and keep their distance to it.  The pivots are rows
themselves, so an anchor's k-th best score among them bounds its k-th best of all.  That bound
is a radius around the anchor, and with its distances to the pivots the triangle inequality
says what distances within each cell may serve it.  Anchors form groups near each other; a
row goes only to the groups for whose anchors its place in its cell may serve, and there all
scores are computed exactly in blocks, keeping the best of each anchor.

Two such joins run: the positives (the same label, best first), then the negatives (another
label, scores within a band below each positive's).  A group's rows are dealt by hash to
shards, so a cell that holds most rows is many tasks; a task returns the best of each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import column, tidy, written
from leafmill.llm.wordcols import fits_broadcast
from leafmill.llm.vectors import common_width, integer_vectors, matrix, slices, whole_vectors

FACTOR, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is within these hundredths of its positive's.
BAND = (30, 90)
#: Most pivots, and most components of all of them together: they are sent to every task.
PIVOTS, PIVOT_VALUES = 1024, 1 << 20
GROUP_ANCHORS = 2048
#: Rows of a shard: at most so many, and fewer while that makes under SHARDS of them.
SHARD_ROWS, LEAST_SHARD_ROWS, SHARDS = 1 << 17, 1 << 13, 64
NONE = np.iinfo(np.int64).min
#: Distances are compared with this relative and absolute slack, far above their rounding.
SLACK = 1e-7


def lifted(q: np.ndarray, bound: float) -> np.ndarray:
    """Rows with their further component."""
    x = q.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(bound - (x * x).sum(1), 0))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; components are small enough for double precision (vectors.largest)."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def band(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative of positives with these scores."""
    low, high = BAND
    return -((-low * positive) // 100), (high * positive) // 100


class Best:
    """The best k of rows that come in order of id, for each slot of several; ties go to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), NONE)
        self.id = np.zeros((slots, k), np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """slot, score and id of candidates, whose ids aren't below any that came before."""
        used = np.unique(slot)
        k = self.k
        old = np.repeat(used, k)
        slot = np.concatenate([old, slot])
        score, ids = (np.concatenate([mine[used].ravel(), new]) for mine, new in ((self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score.astype(np.float64), slot))
        slot, score, ids = slot[order], score[order], ids[order]
        at = np.searchsorted(slot, used)[:, None] + np.arange(k)
        self.score[used], self.id[used] = score[at], ids[at]

    def least(self) -> np.ndarray:
        """Scores that a new candidate must pass."""
        return self.score[:, -1]


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    """Growing blocks, since the first ones meet no bound yet."""
    at, size = 0, 128
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(1024, size * 2)


def _nearest(pivots, bound: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            q, anchor = matrix(column(batch, "q")), np.asarray(column(batch, "anchor").to_numpy(zero_copy_only=False), bool)
            x = lifted(q, bound)
            far = distances(x, lifted(pivots.value[2], bound))
            cell = far.argmin(1)
            home = np.full(len(q), -1)
            if anchor.any():
                home[anchor] = distances(np.column_stack([q[anchor].astype(np.float64), np.zeros(anchor.sum())]), lifted(pivots.value[2], bound)).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in ("vec_id", "label", "anchor", "q")), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(q)), cell]), pa.array(home.astype(np.int32))],
                ["vec_id", "label", "anchor", "q", "cell", "reach", "home"],
            )

    return run


def _best_of_pivots(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, pivots, k: int, low: np.ndarray | None, high: np.ndarray | None) -> np.ndarray:
    """For each anchor, or anchor and positive, the k-th best score of pivots that may serve it, or NONE."""
    pivot_ids, pivot_labels, pivot_q = pivots
    found = scores(q, pivot_q)
    if low is None:
        allowed = (labels[:, None] == pivot_labels) & (ids[:, None] != pivot_ids)
        found = np.where(allowed, found, NONE)[:, None, :]
    else:
        allowed = (labels[:, None] != pivot_labels) & (ids[:, None] != pivot_ids)
        found = np.where(allowed[:, None, :] & (found[:, None, :] >= low[:, :, None]) & (found[:, None, :] <= high[:, :, None]), found[:, None, :], NONE)
    if found.shape[2] < k:
        return np.full(found.shape[:2], NONE)
    return np.partition(found, found.shape[2] - k, axis=2)[:, :, -k]


def _spans(pivots, bound: float, k: int, slots: int):
    """Of each group of anchors, the anchors with their bounds, and the stretch of each cell that may serve them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            n = batch.num_rows
            ids, labels, group = (column(batch, c).to_numpy() for c in ("vec_id", "label", "group"))
            q = matrix(column(batch, "q"))
            if slots:
                low, high = (matrix(column(batch, c)) for c in ("low", "high"))
                floor = np.empty((n, slots), np.int64)
                for s in range(0, n, 256):
                    floor[s : s + 256] = _best_of_pivots(ids[s : s + 256], labels[s : s + 256], q[s : s + 256], pivots.value, k, low[s : s + 256], high[s : s + 256])
                floor = np.maximum(floor, low)
                serves = low <= high
            else:
                floor = _best_of_pivots(ids, labels, q, pivots.value, k, None, None)
                high, serves = np.full((n, 1), np.iinfo(np.int64).max), np.ones((n, 1), bool)
            x = np.column_stack([q.astype(np.float64), np.zeros(n)])
            norm = (x * x).sum(1)[:, None] + bound
            # A score s is the distance sqrt(norm - 2 s); no bound is an endless distance.
            most = np.where(floor == NONE, np.inf, np.sqrt(np.maximum(norm - 2.0 * floor, 0))) * (1 + SLACK) + SLACK
            least = np.sqrt(np.maximum(norm - 2.0 * np.where(high == np.iinfo(np.int64).max, norm, high), 0)) * (1 - SLACK) - SLACK
            most = np.where(serves, most, -np.inf).max(1)
            least = np.where(serves, least, np.inf).min(1)
            ends = distances(x, lifted(pivots.value[2], bound))
            error = 1e-6 * (1 + math.sqrt(bound))
            from_ = np.maximum(ends - most[:, None], least[:, None] - ends) - error
            to = ends + most[:, None] + error
            for g in np.unique(group):
                rows = (group == g) & np.isfinite(least)
                if not rows.any():
                    continue
                first, last = from_[rows].min(0), to[rows].max(0)
                cell = np.flatnonzero(first <= last)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), g)), pa.array(cell.astype(np.int32)), pa.array(first[cell]), pa.array(last[cell])], ["group", "cell", "first", "last"])

    return run


def _joined(k: int, slots: int):
    """Exact local join of each unit: its anchors come first, then rows in order of vec_id."""

    def finished(anchors: dict, best: Best) -> Iterator[pa.RecordBatch]:
        at, place = np.nonzero(best.score > NONE)
        if len(at):
            width = max(1, slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors["row"][at // width]), pa.array((at % width).astype(np.int32)), *(pa.array(x[at, place]) for x in (best.score, best.id))],
                ["row", "slot", "score", "other"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, anchors, best = None, [], None, None
        for batch in batches:
            units, kinds = column(batch, "unit").to_numpy(), column(batch, "kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1), len(units)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                rows = batch.slice(s, e - s)
                if units[s] != unit:
                    if best is not None:
                        yield from finished(anchors, best)
                    unit, parts, anchors, best = units[s], [], None, None
                if kinds[s] == 0:
                    parts.append(rows)
                    continue
                if best is None:
                    if not parts:
                        continue
                    held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    anchors = {c: column(held, c).to_numpy() for c in ("row", "vec_id", "label")} | {"q": matrix(column(held, "q"))}
                    anchors |= {c: matrix(column(held, c)) for c in ("low", "high")} if slots else {}
                    best = Best(len(anchors["row"]) * max(1, slots), k)
                ids, labels, q = column(rows, "vec_id").to_numpy(), column(rows, "label").to_numpy(), matrix(column(rows, "q"))
                for a, b in _blocks(len(ids)):
                    _add(best, anchors, ids[a:b], labels[a:b], scores(anchors["q"], q[a:b]), slots)
        if best is not None:
            yield from finished(anchors, best)

    return run


def _add(best: Best, anchors: dict, ids: np.ndarray, labels: np.ndarray, found: np.ndarray, slots: int) -> None:
    least, same = best.least(), anchors["label"][:, None] == labels
    apart = anchors["vec_id"][:, None] != ids
    if not slots:
        i, j = np.nonzero((found > least[:, None]) & same & apart)
        best.add(i, found[i, j], ids[j])
        return
    other = ~same & apart
    for t in range(slots):
        low, high = anchors["low"][:, t], anchors["high"][:, t]
        i, j = np.nonzero((found > np.maximum(least[t::slots], low - 1)[:, None]) & (found <= high[:, None]) & other)
        best.add(i * slots + t, found[i, j], ids[j])


def _pivots(rows: DataFrame, n: int, width: int):
    """Ids, labels and components of distinct rows, picked by hash: a bounded sample, as many as the root of the rows."""
    wanted = max(1, min(PIVOTS, PIVOT_VALUES // max(1, width), math.isqrt(n) + 1))
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(12)), "vec_id", "label", "q").select("vec_id", "label", "q").limit(2 * wanted).collect()
    apart = {tuple(r.q): r for r in reversed(picked)}
    kept = list(apart.values())[-wanted:]
    return np.array([r.vec_id for r in kept], np.int64), np.array([r.label for r in kept], np.int64), np.array([r.q for r in kept], np.int64)


def _join(spark: SparkSession, placed: DataFrame, anchors: DataFrame, pivots, bound: float, n: int, k: int, slots: int) -> DataFrame:
    """(row, slot, rank, score, other): the best k of each anchor, or of each anchor's slots."""
    named = ["unit", "kind", "vec_id", "row", "label", "q", "low", "high"]
    spans = written(anchors.mapInArrow(tidy(_spans(pivots, bound, k, slots)), "group bigint, cell int, first double, last double"), "spans")
    # A group's anchors may come in several batches; their stretches are put together.
    spans = written(spans.groupBy("group", "cell").agg(F.min("first").alias("first"), F.max("last").alias("last")), "spans")
    spans = F.broadcast(spans) if fits_broadcast(spans, "cell") else spans
    rows = max(LEAST_SHARD_ROWS, min(SHARD_ROWS, n // SHARDS))
    shards = max(1, math.ceil(n / rows))
    unit = F.xxhash64("group", "shard")
    sent = placed.select("vec_id", "label", "q", "cell", "reach").join(spans, "cell").where((F.col("reach") >= F.col("first")) & (F.col("reach") <= F.col("last")))
    sent = sent.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    empty = F.array().cast("array<bigint>")
    candidates = sent.select(unit.alias("unit"), F.lit(1).alias("kind"), "vec_id", F.lit(0).cast("bigint").alias("row"), "label", "q", empty.alias("low"), empty.alias("high"))
    each = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ends = each.select(unit.alias("unit"), F.lit(0).alias("kind"), "vec_id", "row", "label", "q", *(F.col(c) if slots else empty.alias(c) for c in ("low", "high")))
    units = candidates.unionByName(ends).repartition("unit").sortWithinPartitions("unit", "kind", "vec_id").select(*named)
    found = units.mapInArrow(tidy(_joined(k, slots)), "row bigint, slot int, score bigint, other bigint")
    best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "other")
    return written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "best")


def hard_negatives(vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", factor: int = FACTOR) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, label, embedding).

    Rows without vec_id or label, with a null or empty vector, with null or non-finite
    components, or of another length than the commonest take no part.  A row and others of its
    vec_id are never each other's positives or negatives; repeated rows count each on its own.
    Components beyond vectors.largest are held there.  Other columns are ignored; an empty table
    gives no rows.  Labels are whole numbers.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors.where("vec_id is not null and label is not null"), ["cast(vec_id as bigint) as vec_id", "cast(label as bigint) as label"])
    width = common_width(whole)
    if not width:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    rows = integer_vectors(whole, factor, width, {"vec_id": "bigint", "label": "bigint"}).withColumn("anchor", F.expr(is_anchor))
    rows = written(rows, "vectors")
    norm = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x)
    n, bound = rows.agg(F.count("*"), F.max(norm)).first()
    picked = _pivots(rows, n, width)
    pivots, bound = spark.sparkContext.broadcast(picked), float(bound)
    placed = rows.mapInArrow(tidy(_nearest(pivots, bound)), "vec_id bigint, label bigint, anchor boolean, q array<int>, cell int, reach double, home int")
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    anchors = _grouped(placed.where("anchor"), picked[2], bound)
    positives = _join(spark, placed, anchors, pivots, bound, n, POSITIVES, 0)
    lists = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "other"))).alias("best"))  # POSITIVES at most
    score = lambda i: F.coalesce(F.try_element_at("best.score", F.lit(i + 1)), F.lit(-1))  # noqa: E731  -1 has an empty band
    low, high = BAND
    slots = F.array(*(score(i) for i in range(POSITIVES)))
    wanted = anchors.join(lists, "row").withColumn("scores", slots)
    wanted = wanted.withColumn("low", F.transform("scores", lambda s: F.ceil(s * low / F.lit(100).cast("decimal(3,0)")).cast("bigint")))
    wanted = wanted.withColumn("high", F.transform("scores", lambda s: F.floor(s * high / F.lit(100).cast("decimal(3,0)")).cast("bigint")))
    wanted = written(wanted.drop("best", "scores"), "anchors")
    negatives = _join(spark, placed, wanted, pivots, bound, n, NEGATIVES, POSITIVES)
    ends = positives.select("row", (F.col("rank") - 1).alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    named = negatives.select("row", "slot", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    found = named.join(ends, ["row", "slot"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _grouped(anchors: DataFrame, pivots: np.ndarray, bound: float) -> DataFrame:
    """The anchors with a group of at most about GROUP_ANCHORS near each other, written.

    There are as many regions as full groups of anchors, each around one of the first pivots; the
    anchors of a region that holds more than a group are dealt to several by hash.
    """
    n = anchors.count()
    regions = max(1, min(len(pivots), math.ceil(n / GROUP_ANCHORS)))
    lifted_pivots = lifted(pivots, bound)
    region = distances(lifted_pivots, lifted_pivots[:regions]).argmin(1)
    of_home = F.element_at(F.array(*(F.lit(int(r)) for r in region)), F.col("home") + 1)
    placed = anchors.select("row", "vec_id", "label", "q", of_home.alias("region"))
    sizes = placed.groupBy("region").agg(F.ceil(F.count("*") / F.lit(GROUP_ANCHORS)).cast("bigint").alias("parts"))
    group = F.col("region") + regions * F.pmod(F.xxhash64("row"), F.col("parts"))
    grouped = placed.join(F.broadcast(sizes), "region").withColumn("group", group.cast("bigint"))  # a row for each pivot at most
    return written(grouped.select("row", "vec_id", "label", "q", "group"), "anchors")

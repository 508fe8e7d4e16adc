"""Window operators over frame and page sequences.

Frames come per video in frame order, pages per book in page_ord; every ordering ends in
that ordinal, so ties go by list order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.queue import in_order
from leafmill.sources.shared import kept, tasks_of

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
_BEFORE = (Window.unboundedPreceding, -1)
#: Bits of the places in a block of page_ord: the rows that windows over books look at together.
BLOCK_BITS = 15


def is_body() -> Column:
    """Body pages: no role, not pinned, neither duplicate nor deleted."""
    return F.col("role").isNull() & F.col("pinned").isNull() & ~F.col("status").isin("duplicate", "deleted")


def rest_mask(frames: DataFrame, factor: float = 1.0, least_flatness: float = 0.05) -> DataFrame:
    """frames with at_rest: little motion against the video's median, and flat.

    The first frame counts as still; a video of one frame is at rest whatever it shows.
    """
    stats = frames.groupBy("video").agg(F.median(F.when(F.col("i") > 1, F.col("motion"))).alias("mid"), F.count("*").alias("n"))
    still = (F.col("i") == 1) | (F.col("motion") < F.greatest(F.col("mid") * factor, F.lit(1e-3)))
    rest = (F.col("n") <= 1) | (still & (F.col("flatness") > least_flatness))
    return frames.join(stats, "video").withColumn("at_rest", rest).drop("mid", "n")


def segment_pages(frames: DataFrame, turn_min: int = 2, factor: float = 1.0) -> DataFrame:
    """One row per page capture: video, page, first_i, last_i, n_frames, mean_motion.

    Gaps and islands by count: a run of turn_min or more frames in motion starts another page,
    shorter ones are wobble.  Debris goes: single frames, and fewer than four whose mean
    motion is over twice the median positive motion of the video's frames at rest.
    """
    order = Window.partitionBy("video").orderBy("i")
    rest = rest_mask(frames, factor).where("at_rest")
    gap = F.col("i") - F.lag("i").over(order) - 1
    rest = rest.withColumn("page", F.sum(F.coalesce((gap >= turn_min).cast("int"), F.lit(0))).over(order))
    floor = rest.groupBy("video").agg(F.coalesce(F.median(F.when(F.col("motion") > 0, F.col("motion"))), F.lit(0.0)).alias("floor"))
    pages = rest.groupBy("video", "page").agg(
        F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n_frames"), F.avg("motion").alias("mean_motion")
    )
    pages = pages.join(floor, "video")
    return pages.where("n_frames >= 2 and (n_frames >= 4 or mean_motion <= 2.0 * floor)").drop("floor")


def percentiles(rows: DataFrame, **wanted: tuple[Column, float]) -> DataFrame:
    """One row with the percentile of each column by name, exactly, between two values in proportion; null where there are no values.

    Values are counted, put in order by a range shuffle, and only the ranges in which a percentile
    lies are added up, so no task has all of them.
    """
    shares = F.array(*(F.lit(float(share)) for _, share in wanted.values()))
    each = F.array(*(F.struct(F.lit(k).alias("k"), c.cast("double").alias("v")) for k, (c, _) in enumerate(wanted.values())))
    counts = rows.select(F.explode(each).alias("x")).select("x.*").where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    placed = in_order(counts, ["k", "v"])
    whole = Window.partitionBy("k")
    held = placed.groupBy("k", "__part").agg(F.sum("n").alias("held"))  # a row for each partition
    held = held.withColumn("upto", F.sum("held").over(whole.orderBy("__part"))).withColumn("at", (F.sum("held").over(whole) - 1) * F.get(shares, F.col("k")))
    held = held.withColumns({"lo": F.floor("at"), "hi": F.ceil("at")}).where("upto > lo and upto - held <= hi")
    found = placed.join(F.broadcast(held), ["k", "__part"]).withColumn("end", F.col("upto") - F.col("held") + F.sum("n").over(Window.partitionBy("k", "__part").orderBy("v")))
    ends = found.groupBy("k", "at", "lo", "hi").agg(F.min(F.when(F.col("end") > F.col("lo"), F.col("v"))).alias("a"), F.min(F.when(F.col("end") > F.col("hi"), F.col("v"))).alias("b"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("a")).otherwise((F.col("hi") - F.col("at")) * F.col("a") + (F.col("at") - F.col("lo")) * F.col("b"))
    return ends.agg(*(F.max(F.when(F.col("k") == k, value)).alias(name) for k, name in enumerate(wanted)))


def score_norms(scores: DataFrame) -> DataFrame:
    """One row of corpus-wide norms: sharp_hi (95th percentile) and motion_med (of positive motions)."""
    found = percentiles(scores, sharp_hi=(F.col("sharpness"), 0.95), motion_med=(F.when(F.col("motion") > 0, F.col("motion")), 0.5))
    return found.select(F.coalesce("sharp_hi", F.lit(0.0)).alias("sharp_hi"), F.coalesce("motion_med", F.lit(1.0)).alias("motion_med"))


def composite(weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> Column:
    """Weighted product of normalised sub-scores; needs sharp_hi and motion_med beside the scores."""
    parts = [
        F.when(F.col("sharp_hi") != 0, F.least(F.col("sharpness") / F.col("sharp_hi"), F.lit(1.0))).otherwise(F.lit(0.0)),
        F.col("flatness"),
        F.lit(1.0) - F.least(F.col("occlusion") * 4.0, F.lit(1.0)),
        F.when(F.col("motion_med") != 0, F.lit(1.0) / (F.lit(1.0) + F.col("motion") / F.col("motion_med"))).otherwise(F.lit(1.0)),
    ]
    value = F.lit(1.0)
    for part, weight in zip(parts, weights):
        value = value * F.pow(F.greatest(part, F.lit(1e-6)), F.lit(weight))
    return value


def best_frames(scores: DataFrame) -> DataFrame:
    """Best and second-best frame of each cluster: cluster, canonical, fallback, composite.

    The norms are one row by construction, so joining them needs no shuffle.  Composites equal
    to twelve places are a tie, which the smaller frame wins: products of equal value differ in their last bits.
    Frames are dealt to as many tasks as there are many, whatever number the session has.
    """
    rated = scores.crossJoin(F.broadcast(score_norms(scores))).select("cluster", "frame", composite().alias("composite"))
    rated = rated.repartition(tasks_of(scores), "cluster")
    first = Window.partitionBy("cluster").orderBy(F.desc(F.round("composite", 12)), "frame")
    top = rated.withColumn("r", F.row_number().over(first)).where("r <= 2")
    return top.groupBy("cluster").agg(
        F.max(F.when(F.col("r") == 1, F.col("frame"))).alias("canonical"),
        F.max(F.when(F.col("r") == 2, F.col("frame"))).alias("fallback"),
        F.max(F.when(F.col("r") == 1, F.col("composite"))).alias("composite"),
    )


def low_tail(pages: DataFrame, percentile: float = 0.10) -> DataFrame:
    """Pages whose composite is under half the percentile of all composites."""
    pages = kept(pages)  # read for its percentile, then for itself
    cut = percentiles(pages, cut=(F.col("composite"), percentile))
    return pages.crossJoin(F.broadcast(cut)).where(F.col("composite") < F.col("cut") * 0.5).drop("cut")


def video_parity(pages: DataFrame) -> DataFrame:
    """video, parity: 1 or 0 where more than 80 % of at least five read numbers agree, else null."""
    read = pages.where(is_body() & (F.col("printed_number") >= 1) & ~F.coalesce("number_inferred", F.lit(False)))
    share = F.avg(F.col("printed_number") % 2)
    return read.groupBy("video").agg(F.when(F.count("*") < 5, None).when(share > 0.8, 1).when(share < 0.2, 0).alias("parity"))


def _spanned(rows: DataFrame) -> DataFrame:
    """Adds span and slots, the numbers and places from a to b, of rows without a number."""
    span = F.when(F.col("printed_number").isNull(), F.col("b.n") - F.col("a.n"))
    return rows.withColumn("span", span).withColumn("slots", F.col("b.at") - F.col("a.at"))


def _neighbours(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds the numbered rows around each row: n_a, at_a before and n_b, at_b after; at is the position."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = pages.withColumn("at", F.row_number().over(w))
    mark = F.when(F.col("printed_number").isNotNull(), F.struct(F.col("printed_number").alias("n"), F.col("at").alias("at")))
    rows = rows.withColumn("a", F.last(mark, True).over(w.rowsBetween(*_BEFORE)))
    # What follows is what precedes in the opposite order: a frame that grows, not one that is scanned for every row.
    rows = rows.withColumn("b", F.last(mark, True).over(Window.partitionBy(*keys).orderBy(F.desc("at")).rowsBetween(*_BEFORE)))
    return _spanned(rows)


def _around(pages: DataFrame, keys: list[str], mark: Column, tasks: int, held: dict[str, Column] = {}, over: dict[str, Column] = {}) -> DataFrame:
    """Adds at, the position by page_ord among the rows of the keys, and the nearest rows before (a) and after (b) with a mark: (n, at).

    Windows reach over a block of page_ord; a row for each block then has what the blocks
    before and after hold, so no task has all rows of a key.  held are aggregates of a block,
    __n its rows, and over what windows over the blocks (__of, __block) make of them.
    """
    rows = pages.withColumns({"__of": F.struct(*keys), "__block": F.coalesce(F.shiftright("page_ord", BLOCK_BITS).cast("long"), F.lit(-1 << 63))})
    block, blocks = ["__of", "__block"], Window.partitionBy("__of")
    w = Window.partitionBy(*block).orderBy("page_ord")
    rows = rows.repartition(tasks, *block).withColumn("at", F.row_number().over(w))
    rows = rows.withColumn("__mark", F.when(mark.isNotNull(), F.struct(mark.alias("n"), F.col("at").cast("long").alias("at"))))
    marked = F.when(F.col("__mark").isNotNull(), F.col("at"))
    ends = rows.groupBy(*block).agg(
        F.count("*").alias("__n"), F.min_by("__mark", marked).alias("__first"), F.max_by("__mark", marked).alias("__last"), *(c.alias(name) for name, c in held.items())
    )
    ends = ends.withColumn("__earlier", F.coalesce(F.sum("__n").over(blocks.orderBy("__block").rowsBetween(*_BEFORE)), F.lit(0)))

    def placed(name: str) -> Column:
        there = F.struct(F.col(f"{name}.n").alias("n"), (F.col(f"{name}.at") + F.col("__earlier")).alias("at"))
        return F.when(F.col(name).isNotNull(), there)

    ends = ends.select(
        *block,
        "__earlier",
        F.last(placed("__last"), True).over(blocks.orderBy("__block").rowsBetween(*_BEFORE)).alias("__a"),
        F.last(placed("__first"), True).over(blocks.orderBy(F.desc("__block")).rowsBetween(*_BEFORE)).alias("__b"),
        *(c.alias(name) for name, c in over.items()),
    )
    rows = rows.withColumn("a", F.last("__mark", True).over(w.rowsBetween(*_BEFORE)))
    rows = rows.withColumn("b", F.last("__mark", True).over(Window.partitionBy(*block).orderBy(F.desc("at")).rowsBetween(*_BEFORE)))
    rows = rows.join(ends, block).withColumns({"a": F.coalesce(placed("a"), "__a"), "b": F.coalesce(placed("b"), "__b"), "at": F.col("at") + F.col("__earlier")})
    return rows.drop(*block, "__mark", "__earlier", "__a", "__b")


def infer_from_video_order(pages: DataFrame) -> DataFrame:
    """Numbers body pages between two numbered ones of their video where steps of 1 or 2, up or down, fit exactly."""
    rows = _neighbours(pages.where(is_body()), ["book_id", "video"], "frame_no")
    step = F.expr("span div slots")
    fits = (F.col("span") != 0) & (F.col("span") % F.col("slots") == 0) & F.abs(step).between(1, 2)
    value = F.when(fits, F.col("a.n") + (F.col("at") - F.col("a.at")) * step)
    known = rows.select("book_id", "page_ord", value.alias("value")).where("value is not null")
    out = pages.join(known, ["book_id", "page_ord"], "left")
    inferred = F.col("value").isNotNull()
    if "number_inferred" in pages.columns:
        inferred = inferred | F.coalesce("number_inferred", F.lit(False))
    return out.withColumn("printed_number", F.coalesce("printed_number", "value")).withColumn("number_inferred", inferred).drop("value")


def infer_missing(pages: DataFrame) -> DataFrame:
    """Numbers body pages by their place in the book, ascending only; too many pages for a gap are conflicts.

    A value of the wrong parity for its video is not given.
    """
    pages = kept(pages)  # read for numbers around, for parities and for itself
    body = pages.where(is_body()).select("book_id", "video", "page_ord", "printed_number")
    rows = _spanned(_around(body, ["book_id"], F.col("printed_number"), tasks_of(pages)))
    rows = rows.join(video_parity(pages.withColumn("number_inferred", F.coalesce("number_inferred", F.lit(False)))), "video", "left")
    step = F.expr("span div slots")
    fits = (F.col("span") > 0) & (F.col("span") % F.col("slots") == 0) & step.between(1, 2)
    value = F.col("a.n") + (F.col("at") - F.col("a.at")) * step
    allowed = F.col("parity").isNull() | (value % 2 == F.col("parity"))
    crowded = ~fits & (F.col("span") > 0) & (F.col("span") <= F.col("slots") - 1)
    found = rows.select("book_id", "page_ord", F.when(fits & allowed, value).alias("value"), F.coalesce(crowded, F.lit(False)).alias("crowded"))
    found = found.where("value is not null or crowded")
    out = pages.join(found, ["book_id", "page_ord"], "left")
    crowded = F.coalesce("crowded", F.lit(False))
    return (
        out.withColumn("status", F.when(crowded & (F.col("status") == "ok"), "suspect").otherwise(F.col("status")))
        .withColumn("number_conflict", crowded)
        .withColumn("number_inferred", F.coalesce("number_inferred", F.lit(False)) | F.col("value").isNotNull())
        .withColumn("printed_number", F.coalesce("printed_number", "value"))
        .drop("value", "crowded")
    )


def reorder(pages: DataFrame) -> DataFrame:
    """new_ord of each page: pinned start, then by number or interpolated key, then pinned end.

    An unnumbered page goes between its own video's numbered neighbours; one without any
    follows the page before it.  A book without numbers keeps its order.
    """
    group = F.when(F.col("pinned") == "end", 2).when((F.col("pinned") == "start") | (F.col("role") == "cover"), 0).otherwise(1)
    tasks = tasks_of(pages)
    rows = pages.select("book_id", "page_ord", "video", "frame_no", "printed_number", group.alias("part"))
    own = Window.partitionBy("book_id", "part", "video").orderBy("frame_no")
    n = F.col("printed_number")
    rows = rows.withColumn("pa", F.last("printed_number", True).over(own.rowsBetween(*_BEFORE)))
    back = Window.partitionBy("book_id", "part", "video").orderBy(F.desc("frame_no"))
    rows = rows.withColumn("pb", F.last("printed_number", True).over(back.rowsBetween(*_BEFORE)))
    between = F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), (F.col("pa") + F.col("pb")) / 2)
    near = F.coalesce(between, F.col("pa") + F.lit(0.5), F.col("pb") - F.lit(0.5))
    rows = rows.select("book_id", "page_ord", "part", "printed_number", near.alias("near"))
    blocks = Window.partitionBy("__of").orderBy("__block").rowsBetween(*_ALL)
    rows = _around(
        rows,
        ["book_id", "part"],
        F.when(n.isNotNull() | F.col("near").isNotNull(), F.struct("printed_number", "near")),
        tasks,
        held={"__number": F.min_by("printed_number", F.when(n.isNotNull(), F.col("page_ord"))), "__top": F.max("printed_number")},
        over={
            "many": F.sum("__n").over(blocks),
            "first_number": F.first("__number", True).over(blocks),
            "whole": F.max(F.when(F.col("__of.part") == 1, F.col("__top"))).over(Window.partitionBy("__of.book_id")),
        },
    )
    rows = rows.withColumn("at", F.col("at") - 1)
    base = F.coalesce(n.cast("double"), F.col("near") + F.col("at") * 1e-6)
    before = F.coalesce(F.col("a.n.printed_number").cast("double"), F.col("a.n.near") + (F.col("a.at") - 1) * 1e-6)
    key = F.coalesce(
        base,
        before + F.lit(0.001) * (F.col("at") - (F.col("a.at") - 1)),
        F.col("first_number") - F.lit(0.001) * (F.col("many") - F.col("at")),
        F.col("at").cast("double"),
    )
    key = F.when(F.col("part") == 1, key).otherwise(F.col("at").cast("double"))
    sorts = {"__part_of": F.when(F.col("whole").isNotNull(), F.col("part")), "__key": F.when(F.col("whole").isNotNull(), F.col("key"))}
    rows = rows.select("book_id", "page_ord", key.alias("key"), "whole", "part").withColumns(sorts).drop("whole", "part")
    placed = in_order(rows, ["book_id", *sorts, "page_ord"], tasks).withColumn("__of", F.struct("book_id"))
    held = placed.groupBy("__of", "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = F.sum("__n").over(Window.partitionBy("__of").orderBy("__part").rowsBetween(*_BEFORE))
    held = held.select("__of", "__part", (F.coalesce(earlier, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    page = F.struct("book_id", "page_ord").alias("__page")  # equal to itself even where they are null
    ranks = placed.join(held, ["__of", "__part"]).select(page, "key", (F.col("__row") + F.col("__shift")).cast("int").alias("new_ord"))
    return pages.select("*", page).join(ranks, "__page").select(*pages.columns, "key", "new_ord")


def monotonic_violations(pages: DataFrame) -> DataFrame:
    """Numbered pages whose number isn't above the numbered page before: prev_ord, prev_number too."""
    seen = pages.where("printed_number is not null and status not in ('duplicate', 'deleted')")
    w = Window.partitionBy("book_id").orderBy("page_ord")
    seen = seen.withColumn("prev_number", F.lag("printed_number").over(w)).withColumn("prev_ord", F.lag("page_ord").over(w))
    return seen.where("printed_number <= prev_number").select("book_id", "page_ord", "printed_number", "prev_ord", "prev_number")


def missing_numbers(pages: DataFrame) -> DataFrame:
    """book_id, n: numbers from 1 within the captured range that no body page has."""
    have = pages.where(is_body() & (F.col("printed_number") >= 1)).select("book_id", F.col("printed_number").alias("n")).distinct()
    ends = have.groupBy("book_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    every = ends.select("book_id", F.explode(F.sequence("lo", "hi")).alias("n"))
    return every.join(have, ["book_id", "n"], "left_anti")


def format_ranges(numbers: DataFrame) -> DataFrame:
    """book_id, ranges: '6-7, 14, 22-24' from rows (book_id, n)."""
    w = Window.partitionBy("book_id").orderBy("n")
    islands = numbers.distinct().withColumn("g", F.col("n") - F.row_number().over(w))
    runs = islands.groupBy("book_id", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    listed = F.array_sort(F.collect_list(F.struct("lo", text.alias("t"))))
    return runs.groupBy("book_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("ranges"))


def gap_markers(pages: DataFrame) -> DataFrame:
    """Notices of missing numbers: book_id, before_ord, first_missing, last_missing."""
    seen = pages.where("printed_number >= 1")
    w = Window.partitionBy("book_id").orderBy("page_ord")
    seen = seen.withColumn("last", F.lag("printed_number").over(w)).where("printed_number > last + 1")
    return seen.select("book_id", F.col("page_ord").alias("before_ord"), (F.col("last") + 1).alias("first_missing"), (F.col("printed_number") - 1).alias("last_missing"))


def rank_columns() -> list[Column]:
    """How good a capture is, best first: photo, confidence, frame score; ties by list order."""
    confidence = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    return [F.desc(F.col("patched_source").isNotNull()), F.desc(confidence), F.desc(F.coalesce("composite", F.lit(0.0)))]


def dedupe_by_number(pages: DataFrame) -> DataFrame:
    """pages with status: of the captures of one printed number the best stays, the others are duplicates."""
    takes = (
        F.col("printed_number").isNotNull() & F.col("role").isNull() & (F.col("status") != "deleted")
        & ~F.coalesce(F.col("source").isin("pdf", "epub"), F.lit(False)) & ~F.col("dedupe_exempt") & ~F.col("manual_duplicate")
    )
    # What isn't compared stands alone: pages without a number are many.
    w = Window.partitionBy("book_id", "takes", "printed_number", "alone").orderBy(*rank_columns(), "page_ord")
    rows = pages.withColumn("takes", takes).withColumn("alone", F.when(~F.col("takes"), F.col("page_ord"))).withColumn("r", F.row_number().over(w))
    plain = F.when(F.col("status") == "duplicate", F.when(F.col("manual_duplicate"), "duplicate").otherwise("ok")).otherwise(F.col("status"))
    return rows.withColumn("status", F.when(F.col("takes") & (F.col("r") > 1), "duplicate").otherwise(plain)).drop("takes", "alone", "r")


def monotone_keep(numbers: list[int], weights: list[int]) -> set[int]:
    """Indices of a maximum-weight subsequence that never falls, or never rises; rising wins ties.

    Among equal weights the earliest predecessor and the earliest end are taken.
    """
    (up, rising), (down, falling) = _heaviest(numbers, weights), _heaviest([-x for x in numbers], weights)
    return rising if up >= down else falling


def _heaviest(numbers: list[int], weights: list[int]) -> tuple[int, set[int]]:
    """Weight and indices of the heaviest subsequence that never falls.

    A binary indexed tree over the distinct numbers keeps the best (weight, minus index) of
    each prefix of them, so that n numbers take n log n steps.
    """
    place = {x: k for k, x in enumerate(sorted(set(numbers)), 1)}
    tree, via, ends = [(0, 1)] * (len(place) + 1), [], []
    for i, (x, w) in enumerate(zip(numbers, weights)):
        best, k = (0, 1), place[x]
        while k:
            best = max(best, tree[k])
            k &= k - 1
        via.append(-best[1])
        end = (best[0] + w, -i)
        ends.append(end)
        k = place[x]
        while k <= len(place):
            tree[k] = max(tree[k], end)
            k += k & -k
    weight, last = max(ends)
    at, chain = -last, set()
    while at >= 0:
        chain.add(at)
        at = via[at]
    return weight, chain


def sanitize_numbers(pages: DataFrame) -> DataFrame:
    """Body pages' numbers that break their video's monotone order become null with number_rejected.

    Numbers set by hand weigh 1000 and stay; if keeping to them would cost over three more
    pages, they stay without ruling the others.  Videos with under three numbers are left.
    """

    def fix(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame_no", kind="stable").reset_index(drop=True)
        numbers, manual = [int(x) for x in group.printed_number], [bool(x) for x in group.number_manual]
        keep = set(range(len(group)))
        if len(group) >= 3:
            keep = monotone_keep(numbers, [1000 if m else 1 for m in manual])
            if any(manual):
                free = monotone_keep(numbers, [1] * len(numbers))
                if len(free) > len(keep) + 3:
                    keep = free
        bad = [i not in keep and not m for i, m in enumerate(manual)]
        return pd.DataFrame({"book_id": group.book_id, "page_ord": group.page_ord, "bad": bad})

    numbered = pages.where(is_body() & F.col("printed_number").isNotNull()).select("book_id", "video", "page_ord", "frame_no", "printed_number", "number_manual")
    found = numbered.groupBy("book_id", "video").applyInPandas(fix, "book_id long, page_ord long, bad boolean").where("bad")
    rows = pages.join(found, ["book_id", "page_ord"], "left")
    bad = F.coalesce("bad", F.lit(False))
    return rows.withColumn("printed_number", F.when(~bad, F.col("printed_number"))).withColumn("number_rejected", bad).drop("bad")


def reconcile(pages: DataFrame) -> DataFrame:
    """Numbers, duplicates and order of a book as one fixed plan.

    Automatic duplicates are cleared first, so running it on its own result changes nothing.
    """
    rows = pages.withColumn("status", F.when((F.col("status") == "duplicate") & ~F.col("manual_duplicate"), "ok").otherwise(F.col("status")))
    rows = kept(dedupe_by_number(infer_from_video_order(sanitize_numbers(rows))))
    rows = reorder(rows).drop("key").withColumn("page_ord", F.col("new_ord").cast("long")).drop("new_ord")
    rows = kept(infer_missing(rows))
    return reorder(rows).drop("key")

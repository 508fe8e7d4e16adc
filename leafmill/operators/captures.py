"""The rest of the page life cycle: regions, candidate boxes, manual changes, projects, reading cascades."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import labelled_isbns
from leafmill.operators.resolve import hash_bits, iou, near_hashes
from leafmill.operators.review import needs_escalation
from leafmill.sources.shared import kept


def facsimile_pages(pages: DataFrame) -> DataFrame:
    """Pages with a colour image that are neither duplicate nor deleted."""
    return pages.where("color is not null and status not in ('duplicate', 'deleted')")


def assembled_pages(pages: DataFrame) -> DataFrame:
    """Pages that make up the text: no cover; a missing text is an empty one, so that its place stays."""
    live = pages.where("(role is null or role <> 'cover') and status not in ('duplicate', 'deleted')")
    return live.withColumn("text", F.coalesce("text", F.lit("")))


def unread_pages(pages: DataFrame) -> DataFrame:
    return pages.where("md is null and llm_image is not null and (role is null or role <> 'cover') and status <> 'deleted'")


def whole_page_box(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    """Whether a figure's box is the page itself: over 0.85 of its area, or over 0.93 both ways."""
    w, h = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
    return (w * h > 0.85) | ((w > 0.93) & (h > 0.93))


def uncropped_regions(pages: DataFrame) -> DataFrame:
    """book_id, id, region: regions(array of struct with deleted) whose figure file is not in figures."""
    rows = pages.select("book_id", "id", "figures", F.posexplode("regions").alias("region", "r"))
    letter = F.char(F.lit(97) + F.col("region") % 26)
    name = F.concat(F.lit("figures/"), F.col("id"), F.lit("_"), letter, F.lit(".png"))
    have = F.coalesce(F.array_contains("figures", name), F.lit(False))
    return rows.where(~F.coalesce(F.col("r.deleted"), F.lit(False)) & ~have).select("book_id", "id", "region")


def merge_regions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, regions) by position: what a user placed (user_crop or own_image) stays at its index, gaps are tombstones."""
    a = old.select("id", F.posexplode("regions").alias("k", "old")).where("old.user_crop or old.own_image")
    b = new.select("id", F.posexplode("regions").alias("k", "new"))
    both = a.join(b, ["id", "k"], "full").select("id", "k", F.coalesce("old", "new").alias("r"))
    most = both.groupBy("id").agg(F.max("k").alias("top"), F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("m"))
    return most.select("id", F.transform(F.sequence(F.lit(0), "top"), lambda k: F.try_element_at("m", k)).alias("regions"))


def greedy_boxes(regions: DataFrame, boxes: DataFrame, least: float = 0.05) -> DataFrame:
    """page, region, box: each region in order takes the unused box that overlaps it most, else the largest unused.

    Candidates are computed in parallel; only a page's few are chosen one after the other.
    """
    corners = ("x0", "y0", "x1", "y1")
    a = regions.select("page", "region", *(F.col(c).alias(f"a_{c}") for c in corners))
    b = boxes.select("page", "box", *(F.col(c).alias(f"b_{c}") for c in corners))
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    pairs = a.join(b, "page").select("page", "region", "box", iou().alias("iou"), area.alias("area"))
    listed = pairs.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("region", "box", "iou", "area"))).alias("pairs"))

    @F.udf("array<struct<region:long,box:long>>")
    def choose(pairs):
        used, out = set(), []
        for region, own in groupby(pairs, key=lambda p: p["region"]):
            free = [p for p in own if p["box"] not in used]
            near = [p for p in free if p["iou"] > least]
            best = max(near, key=lambda p: p["iou"]) if near else max(free, key=lambda p: p["area"], default=None)
            if best:
                used.add(best["box"])
                out.append((region, best["box"]))
        return out

    return listed.select("page", F.explode(choose("pairs")).alias("c")).select("page", "c.region", "c.box")


def candidate_boxes(boxes: DataFrame, most: float = 0.6) -> DataFrame:
    """page, box: boxes in order of area, largest first, without those that overlap an accepted one by most or more."""
    corners = ("x0", "y0", "x1", "y1")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    listed = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct((-area).alias("a"), "box", *corners))).alias("boxes"))

    def overlap(r, o) -> float:
        inter = max(min(r["x1"], o["x1"]) - max(r["x0"], o["x0"]), 0) * max(min(r["y1"], o["y1"]) - max(r["y0"], o["y0"]), 0)
        union = -r["a"] - o["a"] - inter
        return inter / union if union > 0 else 0.0

    @F.udf("array<long>")
    def keep(boxes):
        taken = []
        for r in boxes:
            if all(overlap(r, o) < most for o in taken):
                taken.append(r)
        return [r["box"] for r in taken]

    return listed.select("page", F.explode(keep("boxes")).alias("box"))


def _leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of near pairs by label, id_b and id_a, those that join a leader; what has joined before can't lead."""
    label, joined = None, set()
    for batch in batches:
        out = []
        for r in batch.itertuples():
            if r.label != label:
                label, joined = r.label, set()
            if r.id_b not in joined and r.id_a not in joined:
                joined.add(r.id_b)
                out.append((r.label, r.id_b, r.id_a))
        yield pd.DataFrame(out, columns=["label", "id", "leader"])


def figure_clusters(hashes: DataFrame, most: int = 10) -> DataFrame:
    """label, id, leader: in order of id a figure joins the first leader of its label within most bits, else leads.

    Figures of one hash have one leader, so each hash is compared once.  Who leads depends on all
    that came before: a label's near pairs, which are few, are gone through in order in one task,
    that holds those who have joined.
    """
    rows = hashes.select("label", "id", hash_bits(F.col("hash")).alias("bits"))
    whole = F.col("label").isNotNull() & F.col("bits").isNotNull()
    firsts = kept(rows.where(whole).groupBy("label", "bits").agg(F.min("id").alias("id")))
    near = near_hashes(firsts, most)
    placed = near.repartition("label").sortWithinPartitions("label", "id_b", "id_a").mapInPandas(_leaders, f"label {hashes.schema['label'].dataType.simpleString()}, id long, leader long")
    led = firsts.join(placed, ["label", "id"], "left").select("label", "bits", F.coalesce("leader", "id").alias("leader"))
    alone = rows.where(~whole).select("label", "id", F.col("id").alias("leader"))
    return rows.join(led, ["label", "bits"]).select("label", "id", "leader").unionByName(alone)


def keep_sharpest(captures: DataFrame) -> DataFrame:
    """Of each group's captures (two or more) the sharpest stays: group, id, kept; unreadable ones count as -1."""
    w = Window.partitionBy("group").orderBy(F.desc(F.coalesce("sharpness", F.lit(-1.0))), "id")
    return captures.select("group", "id", (F.row_number().over(w) == 1).alias("kept"))


def set_numbers(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """pages after edits(book_id, page_ord, number) by hand, which outlive reconciling."""
    rows = pages.join(edits.withColumnRenamed("number", "by_hand"), ["book_id", "page_ord"], "left")
    hit = F.col("by_hand").isNotNull()
    return rows.withColumn("printed_number", F.coalesce("by_hand", "printed_number")).withColumn("number_manual", hit | F.col("number_manual")).drop("by_hand")


def set_cover(pages: DataFrame, covers: DataFrame) -> DataFrame:
    """pages with covers(book_id, page_ord) as the only cover, at the front: new_ord."""
    rows = pages.join(covers.withColumn("is_cover", F.lit(True)), ["book_id", "page_ord"], "left")
    named = F.max("is_cover").over(Window.partitionBy("book_id"))
    role = F.when(F.col("is_cover"), "cover").when(named & (F.col("role") == "cover"), None).otherwise(F.col("role"))
    w = Window.partitionBy("book_id").orderBy(F.coalesce("is_cover", F.lit(False)).desc(), "page_ord")
    return rows.withColumn("role", role).withColumn("new_ord", F.row_number().over(w)).drop("is_cover")


def project_summary(pages: DataFrame) -> DataFrame:
    """book_id, pages, suspects, duplicates of each book."""
    count = lambda s: F.count_if(F.col("status") == s)
    return pages.groupBy("book_id").agg(F.count_if(~F.col("status").isin("duplicate", "deleted")).alias("pages"), count("suspect").alias("suspects"), count("duplicate").alias("duplicates"))


def capture_queue(missing: DataFrame, reshoots: DataFrame) -> DataFrame:
    """book_id, number, kind, pos: what is left to photograph, by number, missing pages before reshoots."""
    rows = missing.select("book_id", F.col("n").alias("number"), F.lit("missing").alias("kind"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("page_ord"))
    rows = rows.unionByName(reshoots.select("book_id", F.col("printed_number").alias("number"), F.lit("reshoot").alias("kind"), F.lit(1).alias("k"), "page_ord"))
    w = Window.partitionBy("book_id").orderBy(F.col("number").asc_nulls_last(), "k", "page_ord")
    return rows.withColumn("pos", F.row_number().over(w)).select("book_id", "number", "kind", "pos")


#: Readers by name: each maps an iterator of frames (id, image) to (id, reply).
READERS: dict[str, Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]] = {}


def reader(name: str):
    def add(f):
        READERS[name] = f
        return f

    return add


@reader("mock")
def mock_reader(batches):
    """A deterministic reader: every fourth page opens with a heading."""
    for batch in batches:
        yield pd.DataFrame({"id": batch.id, "markdown": [("# Part\n\n" if i % 4 == 0 else "") + f"Text of page {i}." for i in batch.id], "confidence": ["low" if i % 5 == 0 else "high" for i in batch.id], "transcribe_error": [None if i % 11 else "timeout" for i in batch.id]})


@reader("mock_strong")
def mock_strong_reader(batches):
    for batch in mock_reader(batches):
        yield batch.assign(confidence="high", transcribe_error=None)


def read_pages(pages: DataFrame, first: str = "mock", second: str | None = "mock_strong") -> DataFrame:
    """Reads pages(id, image) with one reader and what it is unsure of with a stronger one: id, markdown, confidence,
    transcribe_error, read_by.  The first pass is kept while the second runs, so that no page is read twice.
    """
    schema = "id long, markdown string, confidence string, transcribe_error string"
    rows = pages.select("id", "image")
    done = rows.mapInPandas(READERS[first], schema).withColumn("flags", F.array().cast("array<string>")).withColumn("again", needs_escalation()).persist()
    kept = done.where(~F.col("again") | F.lit(second is None)).withColumn("read_by", F.lit(first))
    if second is None:
        return kept.drop("flags", "again")
    again = rows.join(done.where("again").select("id"), "id", "left_semi").mapInPandas(READERS[second], schema).withColumn("read_by", F.lit(second))
    return kept.drop("flags", "again").unionByName(again)


def by_prior(candidates: DataFrame, prior: DataFrame) -> DataFrame:
    """candidates(page, k, x0, y0, x1, y1) with pos, best overlap with the page's box in prior first, then as they came."""
    corners = ("x0", "y0", "x1", "y1")
    a = candidates.select("page", "k", *(F.col(c).alias(f"a_{c}") for c in corners))
    b = prior.select("page", *(F.col(c).alias(f"b_{c}") for c in corners))
    rows = a.join(b, "page").withColumn("iou", iou())
    w = Window.partitionBy("page").orderBy(F.desc(F.round("iou", 9)), "k")
    return rows.withColumn("pos", F.row_number().over(w)).select("page", "k", "iou", "pos")


def first_isbn(pages: DataFrame) -> DataFrame:
    """book_id, isbn: the first valid labelled book number on a page that counts, in order; books without have no row."""
    live = pages.where("text is not null and (status is null or status not in ('duplicate', 'deleted'))")
    found = live.select("book_id", "page_ord", F.get(labelled_isbns(F.col("text")), 0).alias("isbn")).where("isbn is not null")
    return found.groupBy("book_id").agg(F.min_by("isbn", "page_ord").alias("isbn"))

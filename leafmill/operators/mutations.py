"""Changes that users make to pages, and what each of them makes worthless.

What follows from a change is read off DERIVED, the table of which field is made from which:
all that depends on the root goes, directly or not, but what the change says is kept.  Every
change takes a table of requests, so any number of pages change in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.operators.resolve import capture_key

#: A field and what it is made from.
DERIVED = {"md": "image", "confidence": "md", "flags": "md", "transcribe_error": "md", "printed_number": "md", "regions": "md", "figures": "regions"}
#: What stays although its source has changed.
KEPT = {"patch": {"printed_number"}, "reshoot": {"printed_number"}, "rotation": {"regions", "figures"}}


def fallout(change: str, root: str = "image") -> dict[str, str]:
    """Each field that a change of the root clears, with the field through which it does."""
    out: dict[str, str] = {}
    stack = [root]
    while stack:
        source = stack.pop()
        for field, made_from in DERIVED.items():
            if made_from == source and field not in out and field not in KEPT[change]:
                out[field] = source
                stack.append(field)
    return {f: out[f] for f in DERIVED if f in out}


def _cleared(pages: DataFrame, change: Column, skip: Column | None = None) -> Column:
    """array<struct<field, reason, via>> of the filled fields that the page's change clears, null changes none."""
    rows = []
    for name in KEPT:
        for field, via in fallout(name).items():
            hit = (change == name) & F.col(field).isNotNull()
            if skip is not None and field in ("regions", "figures"):
                hit = hit & ~skip
            rows.append(F.when(hit, F.struct(F.lit(field).alias("field"), F.lit(name).alias("reason"), F.lit(via).alias("via"))))
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def _without(pages: DataFrame, change: Column, new: dict[str, Column]) -> DataFrame:
    gone = lambda c: F.when(change.isin(*(n for n in KEPT if c in fallout(n))), F.lit(None)).otherwise(F.col(c))
    return pages.withColumns({c: new[c] if c in new else gone(c) for c in DERIVED} | {c: e for c, e in new.items() if c not in DERIVED})


def own_regions(regions: Column) -> Column:
    """Regions after a new photo of the page: close-ups of their own stay at their index, others are tombstones, none at the end."""
    empty = F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    tomb = lambda r: r.withField("type", F.lit("figure")).withField("bbox_norm", empty).withField("caption", F.lit("")).withField("deleted", F.lit(True)).withField("user_crop", F.lit(None).cast("boolean"))
    kept = F.transform(regions, lambda r: F.when(F.coalesce(r["own_image"], F.lit(False)), r).otherwise(tomb(r)))
    last = F.array_max(F.transform(kept, lambda r, i: F.when(F.coalesce(r["own_image"], F.lit(False)) & ~F.coalesce(r["deleted"], F.lit(False)), i + 1).otherwise(0)))
    return F.when(last > 0, F.slice(kept, 1, F.greatest(last, F.lit(1))))


def _letter(i: Column) -> Column:
    return F.char(F.lit(97) + i % 26)


def take_photos(pages: DataFrame, photos: DataFrame) -> DataFrame:
    """pages with photos(id, seq, kind patch or reshoot, source, number), and cleared, what each lost and why.

    The page shows its last photo and must be read again; a reshoot for a number confirms it for
    good.  A reshoot keeps close-ups at their index and their files; a patch, among others or
    alone, drops all regions.  Pages without photos stay as they are; photos of unknown pages do nothing.
    """
    last = F.struct("seq", "source", "kind")
    asked = photos.groupBy("id").agg(
        F.max(last).alias("__last"), F.bool_or(F.col("kind") == "patch").alias("__patched"), F.max(F.when((F.col("kind") == "reshoot") & F.col("number").isNotNull(), F.struct("seq", "number"))).alias("__number")
    )
    rows = pages.join(asked, "id", "left").withColumn("__change", F.when(F.col("__last").isNotNull(), F.when(F.col("__patched"), "patch").otherwise("reshoot")))
    kept = F.when(F.col("__change") == "reshoot", own_regions(F.col("regions")))
    rows = rows.withColumn("__kept", kept)
    names = F.transform("__kept", lambda r, i: F.when(F.coalesce(r["own_image"], F.lit(False)), F.concat(F.lit("figures/"), F.col("id"), F.lit("_"), _letter(i), F.lit(".png"))))
    stays = F.coalesce(F.size("__kept") > 0, F.lit(False))
    rows = rows.withColumn("cleared", _cleared(rows, F.col("__change"), stays))
    changed = F.col("__change").isNotNull()
    number = F.col("__number.number")
    new = {
        "regions": F.when(~changed, F.col("regions")).when(stays, F.col("__kept")),
        "figures": F.when(~changed, F.col("figures")).when(stays, F.filter("figures", lambda f: F.array_contains(names, f))),
        "printed_number": F.coalesce(number.cast(pages.schema["printed_number"].dataType), F.col("printed_number")),
        "number_manual": F.col("number_manual") | number.isNotNull(),
        "patched_source": F.coalesce("__last.source", "patched_source"),
        "status": F.when(changed, "patched").otherwise(F.col("status")),
        "needs_reshoot": F.when(F.col("__last.kind") == "reshoot", False).otherwise(F.col("needs_reshoot")),
    }
    return _without(rows, F.coalesce("__change", F.lit("")), new).select(*pages.columns, "cleared")


def _prefixes(name: Column) -> Column:
    """What stands before each underscore of a frame's name: one of them is its video."""
    parts = F.split(name, "_")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "_"))


def turned(videos: DataFrame, rotations: DataFrame) -> DataFrame:
    """video, rotate of those whose rotation really changes; of several requests the last by seq counts."""
    last = rotations.groupBy("video").agg(F.max(F.struct("seq", "rotate"))["rotate"].alias("rotate"))
    return last.join(videos.select("video", F.col("rotate").alias("__now")), "video").where(~F.col("rotate").eqNullSafe(F.col("__now"))).drop("__now")


def rotate_videos(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """pages, those with a frame of a changed video without what was read from it, and cleared."""
    named = pages.where("canonical like '%\\\\_%'").select("id", F.explode(_prefixes(F.col("canonical"))).alias("video"))
    hit = named.join(changed.select("video"), "video", "left_semi").select("id").distinct().withColumn("__change", F.lit("rotation"))
    rows = pages.join(hit, "id", "left")
    rows = rows.withColumn("cleared", _cleared(rows, F.col("__change")))
    return _without(rows, F.coalesce("__change", F.lit("")), {}).select(*pages.columns, "cleared")


def rotate_cache(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Cached readings without those of frames of changed videos; key is a capture's identity."""
    named = cache.select("key", F.explode(_prefixes(F.col("key"))).alias("video")).where("key like '%\\\\_%'")
    return cache.join(named.join(changed.select("video"), "video", "left_semi").select("key").distinct(), "key", "left_anti")


def side_key() -> Column:
    """A capture's identity in the cache of readings; halves of a spread share a frame and are told apart by side."""
    return F.when(F.col("side").isNull(), capture_key()).otherwise(F.concat(capture_key(), F.lit("|"), F.col("side")))


def pristine_numbers(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages with the numbers that were read, as the cache has them by capture; manual ones stay.

    What earlier repairs inferred, rejected or found in conflict is forgotten.  Pages that were
    never read keep what they have.
    """
    read = cache.select("key", F.col("printed_number").alias("__read"), F.lit(True).alias("__hit"))
    rows = pages.withColumn("key", side_key()).join(read, "key", "left")
    manual = F.coalesce("number_manual", F.lit(False))
    reset = ~manual & F.coalesce("__hit", F.lit(False))
    off = {c: F.when(reset, False).otherwise(F.col(c)) for c in ("number_inferred", "number_rejected", "number_conflict") if c in pages.columns}
    return rows.withColumns({"printed_number": F.when(reset, F.col("__read")).otherwise(F.col("printed_number"))} | off).select(*pages.columns)


def vouch(pages: DataFrame, edits: DataFrame, reasons: Column) -> DataFrame:
    """pages with edits(id, ignore_suspect, section_set, section): complaints waived, sections named.

    What was complained of is remembered in ignored_reasons.  Only naming a section, or unnaming
    it by a blank one, turns a suspect page to ok.
    """
    rows = pages.join(edits, "id", "left")
    ignore, named = F.coalesce("ignore_suspect", F.lit(False)), F.coalesce("section_set", F.lit(False))
    section = F.nullif(strip(F.coalesce("__section", F.lit(""))), F.lit(""))
    rows = pages.join(edits.withColumnRenamed("section", "__section"), "id", "left")
    return rows.withColumns(
        {
            "ignored_reasons": F.when(ignore, reasons).otherwise(F.col("ignored_reasons")),
            "suspect_ignored": F.col("suspect_ignored") | ignore,
            "section": F.when(named, section).otherwise(F.col("section")),
            "status": F.when(named & (F.col("status") == "suspect"), "ok").otherwise(F.col("status")),
        }
    ).select(*pages.columns)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def _image(rel: Column) -> Column:
    return F.concat(F.lit(r"!\[[^\]]*\]\("), _quoted(rel), F.lit(r"\)"))


def figure_index(rel: Column) -> Column:
    """The index of a figure's region, from the letter that ends its file's name; null without one."""
    letter = F.regexp_extract(rel, r"_([^_/.])[^_/.]*\.[^/.]*$", 1)
    return F.when(letter.rlike("^[a-zA-Z]$"), F.ascii(letter) - F.lit(97)).otherwise(F.lit(None))


def delete_figures(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """pages(id, md_text, regions, figures) without figures(id, rel): a tombstone, no file, no link.

    The region keeps its place, since file names are made from it.
    """
    gone = figures.distinct().groupBy("id").agg(F.array_sort(F.collect_list("rel")).alias("__gone"))
    rows = pages.join(gone, "id", "left")
    none = F.coalesce("__gone", F.array().cast("array<string>"))
    at = F.transform(none, figure_index)
    regions = F.transform("regions", lambda r, i: F.when(F.array_contains(at, i), r.withField("deleted", F.lit(True))).otherwise(r))
    text = F.aggregate(none, F.col("md_text"), lambda t, rel: F.regexp_replace(t, F.concat(_image(rel), F.lit(r"\n?")), F.lit("")))
    return rows.withColumns({"regions": regions, "figures": F.filter("figures", lambda f: ~F.array_contains(none, f)), "md_text": text}).select(*pages.columns)


def set_captions(pages: DataFrame, captions: DataFrame) -> DataFrame:
    """pages with captions(id, seq, rel, caption) on the regions and as the images' texts; the last by seq counts."""
    last = captions.groupBy("id", "rel").agg(F.max(F.struct("seq", "caption"))["caption"].alias("caption"))
    asked = last.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rel", strip(F.coalesce("caption", F.lit(""))).alias("caption")))).alias("__asked"))
    rows = pages.join(asked, "id", "left").withColumn("__asked", F.coalesce("__asked", F.array().cast("array<struct<rel:string,caption:string>>")))
    mine = lambda i: F.try_element_at(F.filter("__asked", lambda c: figure_index(c["rel"]) == i), F.lit(1))
    regions = F.transform("regions", lambda r, i: F.when(mine(i).isNotNull(), r.withField("caption", mine(i)["caption"]).withField("caption_manual", F.lit(True))).otherwise(r))
    safe = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    text = F.aggregate("__asked", F.col("md_text"), lambda t, c: F.regexp_replace(t, _image(c["rel"]), safe(F.concat(F.lit("!["), c["caption"], F.lit("]("), c["rel"], F.lit(")")))))
    return rows.withColumns({"regions": regions, "md_text": text}).select(*pages.columns)


def swap_captions(pages: DataFrame, swaps: DataFrame) -> DataFrame:
    """pages on which the figures of swaps(id, a, b), one a page, have each other's captions."""
    rows = pages.join(swaps, "id").where(figure_index(F.col("a")).isNotNull() & figure_index(F.col("b")).isNotNull())
    caption = lambda rel: F.coalesce(F.get("regions", figure_index(F.col(rel)))["caption"], F.lit(""))
    pair = F.array(F.struct(F.col("a").alias("rel"), caption("b").alias("caption")), F.struct(F.col("b").alias("rel"), caption("a").alias("caption")))
    return set_captions(pages, rows.select("id", F.lit(0).alias("seq"), F.inline(pair)))


def rotation_of(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """frames(frame) with their video's rotation, 0 where it has none; the video is what stands before the first underscore."""
    rows = frames.withColumn("video", F.substring_index("frame", "_", 1))
    return rows.join(videos.select("video", "rotate"), "video", "left").withColumn("rotate", F.coalesce("rotate", F.lit(0))).drop("video")

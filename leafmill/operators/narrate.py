"""Casts, quotes and narration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import pytext
from leafmill.sources.shared import pieces


def cast_aggregate(quotes: DataFrame, samples: int = 3, chars: int = 160) -> DataFrame:
    """speaker, quotes, samples: how often each speaks, and the first quotes; the narrator isn't one."""
    rows = quotes.where("speaker <> 'NARRATOR'")
    w = Window.partitionBy("speaker").orderBy("chapter", "ord")
    first = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("q", 1, chars).alias("q")))), lambda x: x["q"])
    counts = rows.groupBy("speaker").agg(F.count("*").alias("quotes"))
    return counts.join(first.groupBy("speaker").agg(listed.alias("samples")), "speaker")


def chapter_stats(quotes: DataFrame, voices: DataFrame) -> DataFrame:
    """chapter, quotes, voiced, voices: how many quotes, how many with a voice, how many speakers with one."""
    rows = quotes.join(voices, "speaker", "left")
    has = F.col("voice").isNotNull()
    return rows.groupBy("chapter").agg(F.count("*").alias("quotes"), F.count_if(has).alias("voiced"), F.countDistinct(F.when(has, F.col("speaker"))).alias("voices"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        cut = [pytext.speech_chunks(t) if t is not None else [] for t in batch.column("text").to_pylist()]
        rows = pa.array([k for k, parts in enumerate(cut) for _ in parts], pa.int32())
        places = pa.array([n for parts in cut for n in range(len(parts))], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), places, pa.array([p for parts in cut for p in parts], pa.string())], ["doc_id", "part", "text"])


def speech_chunks(texts: DataFrame) -> DataFrame:
    """doc_id, part, text: each text in as many pieces as a voice says at once."""
    return texts.select("doc_id", "text").mapInArrow(_chunks, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, part int, text string")


def estimate(chapters: DataFrame, per_minute: float = 1216.0, synthesis: float = 1.11) -> DataFrame:
    """chapters(chars) with minutes of audio and of its synthesis, to one decimal."""
    minutes = F.col("chars") / per_minute
    return chapters.withColumn("minutes", F.round(minutes, 1)).withColumn("synth_minutes", F.round(minutes * synthesis, 1))


def markers(pieces: DataFrame, keys: list[str], order: str, speed: float = 1.0) -> DataFrame:
    """pieces(seconds) with start_ms and end_ms on a timeline that runs speed times as fast."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("seconds") / speed
    end = F.sum(length).over(w)
    start = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ms = lambda t: F.floor(F.round(t * 1000, 6)).cast("long")
    return pieces.select(*keys, order, ms(start).alias("start_ms"), ms(end).alias("end_ms"))


def _listed(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("ord", "speaker", "q"))).alias("quotes"))


def located(chapters: DataFrame, quotes: DataFrame) -> DataFrame:
    """chapter, ord, speaker, start, stop of each quote found in its chapter's text."""

    @F.udf("array<struct<ord:long,speaker:string,start:int,stop:int>>")
    def find(text, listed):
        hits = pytext.locate_quotes(text or "", [x["q"] or "" for x in listed])
        return [(listed[k]["ord"], listed[k]["speaker"], a, b) for k, a, b in hits]

    rows = chapters.join(_listed(quotes), "chapter").select("chapter", F.explode(find("text", "quotes")).alias("x"))
    return rows.select("chapter", "x.*")


def segments(chapters: DataFrame, quotes: DataFrame, voices: DataFrame) -> DataFrame:
    """chapter, part, voice, text: the chapter as runs of one voice; '' is the narrator."""
    spans = located(chapters, quotes).join(voices, "speaker", "left")
    listed = spans.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.coalesce("voice", F.lit("")).alias("voice")))).alias("spans"))

    @F.udf("array<struct<voice:string,text:string>>")
    def cut(text, spans):
        return pytext.voice_segments(text or "", [tuple(s) for s in spans or []])

    rows = chapters.join(listed, "chapter", "left").select("chapter", F.posexplode(cut("text", "spans")).alias("part", "x"))
    return rows.select("chapter", "part", "x.*")


def by_title_or_place(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """rows(book_id, idx, title, ...) with ch_idx of chapters(book_id, ch_idx, title): same title, else same place."""
    first = chapters.groupBy("book_id", "title").agg(F.min("ch_idx").alias("by_title"))
    places = chapters.select("book_id", F.col("ch_idx").alias("idx"), F.col("ch_idx").alias("by_place"))
    out = rows.join(first, ["book_id", "title"], "left").join(places, ["book_id", "idx"], "left")
    return out.withColumn("ch_idx", F.coalesce("by_title", "by_place")).drop("by_title", "by_place")


def resolve_voices(wanted: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """wanted(book_id, voice) with path: the book's own recording, else the shared one, else null."""
    a = own.select("book_id", "voice", F.col("path").alias("own_path"))
    b = shared.select("voice", F.col("path").alias("shared_path"))
    return wanted.join(a, ["book_id", "voice"], "left").join(b, "voice", "left").select("book_id", "voice", F.coalesce("own_path", "shared_path").alias("path"))


def carry_voices(cast: DataFrame, before: DataFrame) -> DataFrame:
    """cast(speaker, ...) with the voice that before(speaker, voice) gave each name, '' if none."""
    return cast.join(before.select("speaker", "voice"), "speaker", "left").fillna("", ["voice"])


def chapter_metadata(pieces: DataFrame, keys: list[str], order: str, speed: float = 1.0) -> DataFrame:
    """One text per book: chapter marks in the metadata form that audio containers take, from pieces(title, seconds)."""
    from leafmill.functions.text import meta_escape

    rows = markers(pieces, keys, order, speed).join(pieces.select(*keys, order, "title"), [*keys, order])
    block = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), "start_ms", F.lit("\nEND="), "end_ms", F.lit("\ntitle="), meta_escape(F.col("title")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x["b"])
    return rows.groupBy(*keys).agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(listed, "\n"), F.lit("\n")).alias("metadata"))

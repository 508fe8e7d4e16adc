"""Who says what in a book: analysis window by window, merged by chapter, kept where nothing has to be done."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import pytext
from leafmill.functions.replies import cast_reply
from leafmill.sources.shared import pieces

KEY = ["book_id", "ch_idx"]
QUOTES = "array<struct<q:string,speaker:string>>"
PEOPLE = "array<struct<name:string,description:string,sounds_like:string>>"
#: Quotes of a chapter that are kept, samples of a speaker, and their length.
MOST_QUOTES, SAMPLES, SAMPLE_CHARS = 400, 3, 160


def to_analyse(chapters: DataFrame, previous: DataFrame, mode: str = "all", only: DataFrame | None = None) -> DataFrame:
    """chapters with what is kept of them: again, and quotes, characters and error of the earlier row of that title.

    mode all analyses every chapter; failed those that failed or are new; chapters those of
    only(book_id, ch_idx), of which the others are kept, or empty if they are new.
    """
    old = previous.groupBy("book_id", "title").agg(F.max_by(F.struct("quotes", "characters", "error"), "ch_idx").alias("old"))
    rows = chapters.select(*KEY, "title", "text").join(old, ["book_id", "title"], "left")
    if mode == "failed":
        again = F.col("old").isNull() | F.col("old.error").isNotNull()
    elif mode == "chapters":
        rows = rows.join(only.select(*KEY, F.lit(True).alias("asked")).distinct(), KEY, "left")
        again = F.coalesce("asked", F.lit(False))
    else:
        again = F.lit(True)
    return rows.select(*KEY, "title", "text", again.alias("again"), "old.quotes", "old.characters", "old.error")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        cut = [pytext.paragraph_windows(t or "") for t in batch.column("text").to_pylist()]
        rows = pa.array([k for k, parts in enumerate(cut) for _ in parts], pa.int32())
        keys = [batch.column(c).take(rows) for c in KEY]
        texts = [p for parts in cut for p in parts]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([w for parts in cut for w in range(len(parts))], pa.int32()), pa.array(texts, pa.string())], [*KEY, "w", "text"])


def windows(chapters: DataFrame) -> DataFrame:
    """book_id, ch_idx, w, text: whole paragraphs of a chapter, as much as a reader takes at once."""
    kinds = {c: chapters.schema[c].dataType.simpleString() for c in KEY}
    return chapters.select(*KEY, "text").mapInArrow(_windows, f"book_id {kinds['book_id']}, ch_idx {kinds['ch_idx']}, w int, text string")


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        kept = []
        for text, quotes in zip(batch.column("text").to_pylist(), batch.column("quotes").to_pylist()):
            kept.append([quotes[k] for k, _, _ in pytext.locate_quotes(text or "", [q["q"] for q in quotes])])
        columns = dict(zip(batch.schema.names, batch.columns))
        columns["quotes"] = pa.array(kept, batch.schema.field("quotes").type)
        yield pa.RecordBatch.from_pydict({c: v for c, v in columns.items() if c != "text"})


def analyse(chapters: DataFrame, previous: DataFrame, read: Callable[[DataFrame], DataFrame], mode: str = "all", only: DataFrame | None = None) -> DataFrame:
    """book_id, ch_idx, title, quotes, characters, error of each chapter.

    read maps windows to (book_id, ch_idx, w, reply, failure), once for each chapter that the
    mode asks for.  Windows are put together in order; of their quotes those that stand in the
    text are kept.  A chapter is an error, the first window's, only if no window gave anything.
    """
    rows = to_analyse(chapters, previous, mode, only)
    none = lambda t: F.array().cast(t)
    stays = rows.where(~F.col("again")).select(*KEY, "title", F.coalesce("quotes", none(QUOTES)).alias("quotes"), F.coalesce("characters", none(PEOPLE)).alias("characters"), "error")
    todo = rows.where("again").select(*KEY, "title", "text")
    said = read(windows(todo)).withColumn("r", cast_reply(F.col("reply"), MOST_QUOTES))
    each = said.select(*KEY, F.struct("w", "r.quotes", "r.characters", F.coalesce("failure", "r.error").alias("error")).alias("x"))
    parts = each.groupBy(*KEY).agg(F.array_sort(F.collect_list("x"), lambda a, b: a["w"] - b["w"]).alias("x"))  # a chapter's windows
    quotes = F.slice(F.flatten("x.quotes"), 1, MOST_QUOTES)
    people = F.flatten("x.characters")
    error = F.get(F.filter("x.error", lambda e: e.isNotNull()), 0)
    merged = parts.select(*KEY, quotes.cast(QUOTES).alias("quotes"), people.cast(PEOPLE).alias("characters"), F.when((F.size(quotes) == 0) & (F.size(people) == 0), error).alias("error"))
    full = todo.join(merged, KEY, "left").select(*KEY, "title", "text", F.coalesce("quotes", none(QUOTES)).alias("quotes"), F.coalesce("characters", none(PEOPLE)).alias("characters"), "error")
    done = full.mapInArrow(_located, full.drop("text").schema)
    return stays.unionByName(done)


def people(analysed: DataFrame, previous: DataFrame) -> DataFrame:
    """book_id, name, quotes, description, sounds_like, samples, voice of all who are quoted.

    What a character is like is the first thing said of it; voice is that of
    previous(book_id, name, voice), empty for new ones.
    """
    spoken = analysed.select(*KEY, F.posexplode("quotes").alias("pos", "x")).where("x.speaker <> 'NARRATOR'").select("book_id", F.col("x.speaker").alias("name"), F.struct("ch_idx", "pos").alias("at"), F.substring("x.q", 1, SAMPLE_CHARS).alias("q"))
    counts = spoken.groupBy("book_id", "name").agg(F.count("*").alias("quotes"))
    w = Window.partitionBy("book_id", "name").orderBy("at")
    first = spoken.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLES)
    samples = first.groupBy("book_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "q"))), lambda x: x["q"]).alias("samples"))
    known = analysed.select(*KEY, F.posexplode("characters").alias("pos", "c")).select("book_id", "c.*", F.struct("ch_idx", "pos").alias("at"))
    of = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("at"))), F.lit("")).alias(c)
    known = known.groupBy("book_id", "name").agg(of("description"), of("sounds_like"))
    rows = counts.join(samples, ["book_id", "name"]).join(known, ["book_id", "name"], "left").join(previous.select("book_id", "name", "voice"), ["book_id", "name"], "left")
    return rows.fillna("", ["description", "sounds_like", "voice"])

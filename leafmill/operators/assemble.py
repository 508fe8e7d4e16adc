"""From page lines to chapters.  Lines are rows (book_id, page_ord, line_no, line)."""

from __future__ import annotations

import hashlib
import itertools

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.functions.pytext import joined_pieces as page_pieces
from leafmill.functions.pytext import strip_edges as strip_page_edges
from leafmill.functions.text import norm_line, strip
from leafmill.sources.shared import kept, pieces

HEADING = "^#{1,6}\\s"


def running_lines(lines: DataFrame, least: int = 3, share: float = 0.15) -> DataFrame:
    """book_id, norm: normalised lines that open, or close, many of a book's pages.

    Counted are occurrences among each page's first two and last two non-blank lines, first
    and last ones apart; pages without lines count in the share.
    """
    pages = lines.groupBy("book_id").agg(F.countDistinct("page_ord").alias("pages"))
    solid = lines.where(F.col("line").rlike(r"(?U)\S"))
    up, down = (Window.partitionBy("book_id", "page_ord").orderBy(o) for o in (F.col("line_no"), F.desc("line_no")))
    edges = solid.select("book_id", "line", F.row_number().over(up).alias("up"), F.row_number().over(down).alias("down")).where("up <= 2 or down <= 2")
    edges = edges.select("book_id", norm_line(F.col("line")).alias("norm"), "up", "down")  # of edges alone, since most lines are none
    counts = edges.groupBy("book_id", "norm").agg(F.count_if(F.col("up") <= 2).alias("first"), F.count_if(F.col("down") <= 2).alias("last"))
    often = lambda c: (F.col(c) >= least) & (F.col(c) / F.col("pages") > share)
    return counts.join(pages, "book_id").where((F.col("norm") != "") & (often("first") | often("last"))).select("book_id", "norm")


def strip_edges(lines: DataFrame, refs: tuple[str, ...] = ()) -> DataFrame:
    """book_id, page_ord, text: pages without running headers, footers and page numbers at their edges.

    An edge line near a running line or one of refs, such as the title, counts as one too.
    """
    junk = running_lines(lines).groupBy("book_id").agg(F.sort_array(F.collect_set("norm")).alias("norms"))
    texts = page_texts(lines).join(junk, "book_id", "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, norms: pd.Series) -> pd.Series:
        return pd.Series([strip_page_edges(t, set(n) if n is not None else set(), refs) for t, n in zip(text, norms)])

    return texts.select("book_id", "page_ord", cut("text", "norms").alias("text"))


def page_texts(lines: DataFrame) -> DataFrame:
    """book_id, page_ord, text: a page's lines in order."""
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("book_id", "page_ord").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def drop_repeated_headings(lines: DataFrame) -> DataFrame:
    """Lines without level-1 headings whose normalised form an earlier one of the book has."""
    head = F.col("line").startswith("# ")
    w = Window.partitionBy("book_id", "norm").orderBy("page_ord", "line_no")
    heads = lines.where(head).withColumn("norm", norm_line(F.col("line"))).withColumn("r", F.row_number().over(w)).where("r = 1")
    return lines.where(~F.coalesce(head, F.lit(False))).unionByName(heads.select(*lines.columns))


def toc_entry(line: Column) -> tuple[Column, Column]:
    """(title, number) of a contents line, null where it is none."""
    pattern = r"(?U)^(.{2,60}?)[\s.·]+(\d{1,4})\s*$"
    s = strip(line)
    title = strip(F.regexp_replace(F.regexp_extract(s, pattern, 1), r"(?U)[.·\s]+$", ""))
    good = s.rlike(pattern) & (title != "") & ~title.rlike("^[#!|]")
    return F.when(good, title), F.when(good, F.regexp_extract(s, pattern, 2).try_cast("int"))


def printed_toc(lines: DataFrame) -> DataFrame:
    """book_id, title, number: the entries of the first page that is a table of contents.

    That page has a line 'contents' and at least three entries whose numbers never fall.
    """
    title, number = toc_entry(F.col("line"))
    rows = lines.withColumn("title", title).withColumn("number", number)
    w = Window.partitionBy("book_id", "page_ord").orderBy("line_no")
    entries = rows.where("title is not null").withColumn("falls", F.col("number") < F.lag("number").over(w))
    named = lines.where(F.col("line").rlike(r"(?iU)^#{0,6}\s*contents\s*$")).select("book_id", "page_ord").distinct()
    pages = entries.groupBy("book_id", "page_ord").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("falls"), F.lit(False)).alias("bad"))
    first = pages.where("n >= 3 and not bad").join(named, ["book_id", "page_ord"], "left_semi").groupBy("book_id").agg(F.min("page_ord").alias("page_ord"))
    return entries.join(first, ["book_id", "page_ord"], "left_semi").select("book_id", "title", "number", "line_no")


def chapter_of_page(lines: DataFrame) -> DataFrame:
    """book_id, page_ord, chapter: the heading that opens the page, else the page before's; first 'Front matter'."""
    solid = lines.where(strip(F.col("line")) != "")
    first = solid.groupBy("book_id", "page_ord").agg(F.min_by("line", "line_no").alias("first"))
    own = F.when(F.col("first").startswith("# "), strip(F.expr("substring(first, 3)")))
    w = Window.partitionBy("book_id").orderBy("page_ord").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("own", own).select("book_id", "page_ord", F.coalesce(F.last("own", True).over(w), F.lit("Front matter")).alias("chapter"))


def split_chapters(lines: DataFrame) -> DataFrame:
    """book_id, ch_idx, title, n_lines, text: level-1 headings open chapters.

    Text before the first is 'Front Matter'; headings with nothing under them go, and
    neighbours of one title are one chapter, whose repeated heading lines are left out.
    """
    w = Window.partitionBy("book_id").orderBy("page_ord", "line_no")
    rows = lines.withColumn("head", F.col("line").startswith("# "))
    rows = rows.withColumn("part", F.sum(F.col("head").cast("int")).over(w)).withColumn("at", F.row_number().over(w))
    title = F.coalesce(F.max(F.when(F.col("head"), strip(F.expr("substring(line, 3)")))), F.lit("Front Matter"))
    solid = F.bool_or(~F.col("head") & (strip(F.col("line")) != ""))
    parts = rows.groupBy("book_id", "part").agg(title.alias("title"), solid.alias("solid"))
    order = Window.partitionBy("book_id").orderBy("part")
    # A shell goes unless it repeats the chapter before it, which then takes it in.
    parts = parts.withColumn("kept_before", F.last(F.when(F.col("solid"), F.col("title")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.where(F.col("solid") | (F.col("title") == F.col("kept_before")))
    parts = parts.withColumn("new", F.coalesce((F.col("title") != F.lag("title").over(order)).cast("int"), F.lit(1)))
    parts = parts.withColumn("ch_idx", F.sum("new").over(order) - 1)
    rows = rows.join(parts.select("book_id", "part", "ch_idx", "title", "new"), ["book_id", "part"]).where(~F.col("head") | (F.col("new") == 1))
    listed = F.array_sort(F.collect_list(F.struct("at", "line")))
    return rows.groupBy("book_id", "ch_idx", "title").agg(
        F.count("*").alias("n_lines"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text")
    )


def demote_suppressed(lines: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Headings listed in suppressed(book_id, page_ord, title) as plain lines.

    Only headings meet the list; other lines stay where they are.
    """
    head = F.coalesce(F.col("line").rlike(r"^#{1,6}\s+"), F.lit(False))
    bare = F.regexp_replace("line", r"^#{1,6}\s+", "")
    columns = ["book_id", "page_ord", "line_no"]
    known = suppressed.distinct().withColumn("hit", F.lit(True))
    heads = lines.where(head).withColumn("title", strip(bare)).join(known, ["book_id", "page_ord", "title"], "left")
    return lines.where(~head).select(*columns, "line").unionByName(heads.select(*columns, F.when(F.col("hit"), bare).otherwise(F.col("line")).alias("line")))


def demote_index_letters(lines: DataFrame) -> DataFrame:
    """On pages with two or more single-letter lines, such headings become plain lines."""
    letter = F.col("line").rlike(r"(?U)^\s*#{0,6}\s*[A-Z]\.?\s*$").cast("int")
    w = Window.partitionBy("book_id", "page_ord")
    rows = lines.withColumn("letters", F.sum(letter).over(w))
    plain = F.regexp_replace("line", r"(?U)^\s*#{1,6}\s+([A-Z]\.?)\s*$", "$1")
    return rows.select("book_id", "page_ord", "line_no", F.when(F.col("letters") >= 2, plain).otherwise(F.col("line")).alias("line"))


def manual_sections(texts: DataFrame) -> DataFrame:
    """texts(..., text, section) with the section as opening heading, in place of the page's own one."""
    title = strip(F.coalesce("section", F.lit("")))
    heading = F.concat(F.lit("# "), title)
    own = F.col("text").rlike(r"(?U)^\s*#{1,6}\s")
    replaced = F.regexp_replace("text", r"(?U)^(\s*\n)?#{1,6}\s[^\n]*", F.concat(F.lit("$1"), F.replace(F.replace(heading, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))))
    new = F.when(own, replaced).when(strip(F.col("text")) == "", heading).otherwise(F.concat(heading, F.lit("\n\n"), F.col("text")))
    return texts.withColumn("text", F.when(title == "", F.col("text")).otherwise(new))


def insert_chapter_breaks(texts: DataFrame, toc: DataFrame) -> DataFrame:
    """texts(book_id, page_ord, printed_number, text): pages that toc(book_id, title, number) names open a chapter.

    A heading among the first three non-blank lines is promoted; else the title is put before.
    """
    w = Window.partitionBy("book_id", "printed_number").orderBy("page_ord")
    rows = texts.withColumn("r", F.row_number().over(w))
    # Of several entries for one page the first by line counts.
    entry = toc.groupBy("book_id", F.col("number").alias("printed_number")).agg(F.min_by("title", "line_no").alias("toc_title"))
    rows = rows.join(entry, ["book_id", "printed_number"], "left")
    lines = F.split("text", "\n")
    solid = F.slice(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"(?U)\S")), 1, 3)
    own = F.get(F.filter(solid, lambda i: F.get(lines, i).rlike(HEADING)), 0)
    raised = F.transform(lines, lambda x, i: F.when(i == own, F.regexp_replace(x, r"^#{1,6}\s*", "# ")).otherwise(x))
    promoted = F.when(own.isNotNull(), F.array_join(raised, "\n")).otherwise(F.concat(F.lit("# "), F.col("toc_title"), F.lit("\n\n"), F.col("text")))
    opens = F.col("toc_title").isNotNull() & (F.col("r") == 1) & (strip(F.col("text")) != "")
    return rows.withColumn("text", F.when(opens, promoted).otherwise(F.col("text"))).drop("r", "toc_title")


def joined_pieces(texts: DataFrame) -> DataFrame:
    """book_id, k, piece: the pieces of a book's joined pages, in order within a partition, a few of them held at a time."""

    def run(batches):
        rows = (r for b in pieces(batches, "text") for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        names = ["book_id", "k", "piece"]
        out, size = [], 0
        for book, group in itertools.groupby(rows, lambda r: r[0]):
            for k, piece in enumerate(page_pieces(t for _, t in group)):
                out.append((book, k, piece))
                size += len(piece)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    kind = texts.schema["book_id"].dataType
    schema = pa.schema([("book_id", to_arrow_type(kind)), ("k", pa.int64()), ("piece", pa.string())])
    rows = texts.select("book_id", "page_ord", F.coalesce("text", F.lit("")).alias("text")).repartition("book_id").sortWithinPartitions("book_id", "page_ord")
    return rows.select("book_id", "text").mapInArrow(run, f"book_id {kind.simpleString()}, k long, piece string")


def join_pages(texts: DataFrame) -> DataFrame:
    """book_id, text: a book's pages in order, with words and sentences healed across breaks."""
    listed = F.array_sort(F.collect_list(F.struct("k", "piece")))
    return joined_pieces(texts).groupBy("book_id").agg(F.array_join(F.transform(listed, lambda x: x["piece"]), "").alias("text"))


def joined_digests(texts: DataFrame) -> DataFrame:
    """book_id, chars, digest (SHA-1) of a book's joined pages, without the whole text anywhere."""

    def run(batches):
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for book, group in itertools.groupby(rows, lambda r: r[0]):
            chars, digest = 0, hashlib.sha1()
            for _, piece in group:
                chars += len(piece)
                digest.update(piece.encode())
            yield pa.RecordBatch.from_pylist([{"book_id": book, "chars": chars, "digest": digest.hexdigest()}], schema)

    kind = texts.schema["book_id"].dataType
    schema = pa.schema([("book_id", to_arrow_type(kind)), ("chars", pa.int64()), ("digest", pa.string())])
    return joined_pieces(texts).select("book_id", "piece").mapInArrow(run, f"book_id {kind.simpleString()}, chars long, digest string")


def assemble(lines: DataFrame, numbers: DataFrame, sections: DataFrame, suppressed: DataFrame, refs: tuple[str, ...] = ()) -> DataFrame:
    """Clean page texts in order, chapters opened: contents read from the raw text, edges stripped, headings
    deduplicated, chapters inserted, manual sections, placeholders and hyphens, suppressed headings and index letters.

    numbers(book_id, page_ord, printed_number), sections(book_id, page_ord, section).
    """
    from leafmill.functions.text import heal_hyphenation, unresolved_placeholders

    toc = printed_toc(lines)
    keys = ["book_id", "page_ord"]
    texts = kept(strip_edges(lines, refs))  # read for its headings, then for its other lines
    texts = page_texts(drop_repeated_headings(page_lines(texts)))
    texts = insert_chapter_breaks(texts.join(numbers, keys, "left"), toc)
    texts = manual_sections(texts.join(sections, keys, "left"))
    texts = texts.select(*keys, heal_hyphenation(unresolved_placeholders(F.col("text"))).alias("text"))
    # What is suppressed comes to a page once, not to each of its lines.
    titles = suppressed.groupBy(*keys).agg(F.collect_set("title").alias("titles"))
    lines = texts.join(titles, keys, "left").select(*keys, "titles", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bare = F.regexp_replace("line", r"^#{1,6}\s+", "")
    hit = F.col("line").rlike(r"^#{1,6}\s+") & F.coalesce(F.array_contains("titles", strip(bare)), F.lit(False))
    return page_texts(demote_index_letters(lines.select(*keys, "line_no", F.when(hit, bare).otherwise(F.col("line")).alias("line"))))


def page_lines(texts: DataFrame) -> DataFrame:
    return texts.select("book_id", "page_ord", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def restyle_titles(headings: DataFrame) -> DataFrame:
    """headings(book_id, ch_no, title, inserted): inserted 'Chapter n' titles in the style that two or more others share."""
    from leafmill.functions.text import number_title, title_style

    own = headings.where(~F.col("inserted")).withColumn("style", title_style(F.col("title"))).where("style is not null")
    counts = own.groupBy("book_id", "style").agg(F.count("*").alias("n")).where("n >= 2")
    style = counts.groupBy("book_id").agg(F.max_by("style", F.struct("n", "style")).alias("style"))
    rows = headings.join(style, "book_id", "left")
    new = F.when(F.col("inserted") & F.col("title").rlike("^Chapter [0-9]+$"), number_title(F.col("ch_no"), F.coalesce("style", F.lit("")))).otherwise(F.col("title"))
    return rows.withColumn("title", new).drop("style")

"""EPUB archives as pages: a row a chapter, in reading order, with its pictures.

Archives are read by Spark's binary file source, so they may lie wherever Spark reads, and
each is taken apart in the task that has it.
"""

from __future__ import annotations

import itertools
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.pytext import html_chapters

PAGE = "path string, title string, author string, page_ord int, page_id string, role string, text string, figures array<struct<rel:string,caption:string,content:binary>>, error string"
#: Names of an archive's own contents pages, and how many letters name a page's pictures.
CONTENTS, LETTERS = ("nav", "toc"), 26
#: Pages of an archive that are handed on together.
AT_ONCE = 500
_PICTURE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class _Archive:
    """The package of an archive: its metadata, items and reading order."""

    def __init__(self, content: bytes | pa.Buffer):
        self.zip = zipfile.ZipFile(pa.BufferReader(content))
        container = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        name = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(self.zip.read(name))
        base, self.meta, self.items, self.spine = posixpath.dirname(name), {}, {}, []
        for e in package.iter():
            tag = _local(e.tag)
            if tag in ("title", "creator"):
                self.meta.setdefault(tag, (e.text or "").strip())
            elif tag == "meta" and e.get("name") == "cover":
                self.meta.setdefault("cover", e.get("content"))
            elif tag == "item":
                file = posixpath.normpath(posixpath.join(base, unquote(e.get("href") or "")))
                self.items[e.get("id")] = (file, e.get("media-type") or "", (e.get("properties") or "").split())
            elif tag == "itemref":
                self.spine.append(e.get("idref"))
        self.files = set(self.zip.namelist())
        self.pictures = {posixpath.basename(f): f for f, kind, _ in self.items.values() if kind.startswith("image/") and f in self.files}

    def cover(self) -> str | None:
        marked = [f for f, _, properties in self.items.values() if "cover-image" in properties]
        named = self.items.get(self.meta.get("cover"))
        return next((f for f in [*marked, *([named[0]] if named else [])] if f in self.files), None)

    def documents(self) -> Iterator[str]:
        """The documents to read, in order, without the archive's own contents pages."""
        for ref in self.spine:
            file, kind, properties = self.items.get(ref, ("", "", []))
            stem = posixpath.splitext(posixpath.basename(file))[0].lower()
            if file in self.files and "html" in kind and "nav" not in properties and stem not in CONTENTS:
                yield re.sub(r"<\?xml[^>]*\?>", "", self.zip.read(file).decode("utf-8", "ignore"))


def each_page(archive: _Archive) -> Iterator[dict]:
    """An archive's pages: the cover, then a page for each chapter of each document."""
    at = 0
    shared = {"title": archive.meta.get("title"), "author": archive.meta.get("creator"), "error": None}

    def page(role: str | None, text: str | None, figures: list[dict]) -> dict:
        return shared | {"page_ord": at, "page_id": f"p{at + 1:04d}", "role": role, "text": text, "figures": figures}

    cover = archive.cover()
    if cover:
        yield page("cover", None, [{"rel": f"patches/p0001{posixpath.splitext(cover)[1] or '.jpg'}", "caption": "", "content": archive.zip.read(cover)}])
        at += 1
    for html in archive.documents():
        for section in html_chapters(html):
            figures: list[dict] = []

            def figure(m: re.Match, figures=figures) -> str:
                file = archive.pictures.get(posixpath.basename(unquote(m[2])))
                if file is None or len(figures) >= LETTERS:
                    return ""
                rel = f"figures/p{at + 1:04d}_{chr(97 + len(figures))}.png"
                figures.append({"rel": rel, "caption": m[1].strip(), "content": archive.zip.read(file)})
                return f"![{m[1]}]({rel})"

            text = _PICTURE.sub(figure, section)
            yield page(None, text, figures)
            at += 1


def pages_of(content: bytes | pa.Buffer) -> list[dict]:
    """All of an archive's pages."""
    return list(each_page(_Archive(content)))


_KINDS = {
    "title": pa.string(), "author": pa.string(), "page_ord": pa.int32(), "page_id": pa.string(), "role": pa.string(), "text": pa.string(),
    "figures": pa.list_(pa.struct({"rel": pa.string(), "caption": pa.string(), "content": pa.binary()})), "error": pa.string(),
}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages wait in columns, which take as much room as they have bytes, until their archive is known to be whole."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            table = lambda rows, path=path: pa.RecordBatch.from_pydict({"path": pa.array([path] * len(rows), pa.string())} | {n: pa.array([r.get(n) for r in rows], t) for n, t in _KINDS.items()})
            try:
                pages = each_page(_Archive(content.as_buffer() or b""))
                done = [table(rows) for rows in iter(lambda: list(itertools.islice(pages, AT_ONCE)), [])]
            except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, ValueError) as e:
                done = [table([{"error": f"{type(e).__name__}: {e}"[:300]}])]
            yield from done


def pages(archives: DataFrame) -> DataFrame:
    """PAGE rows of archives(path, content), one archive after the other within a task.

    Chapters follow the spine; contents pages are left out, as are blank documents; headings of
    level 2 serve as chapters where those of level 1 don't.  A page's pictures are lettered and
    keep their bytes; links to pictures that aren't there, or beyond the alphabet, go.  An archive
    that can't be read is one row with error.
    """
    return archives.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(_read, PAGE)


def epub_files(spark: SparkSession, path: str) -> DataFrame:
    """The pages of all EPUB files below path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return pages(rows)

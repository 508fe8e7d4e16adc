"""Writers of books and tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.shared import kept


def snapshot(df: DataFrame, path: str) -> None:
    """Replaces the Parquet table at path: written beside it, then put into its place.

    The table that was there is moved aside and deleted last; should a run end between, the next
    one, or recovered(), puts it back.
    """
    spark = df.sparkSession
    store, at = _store(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    recovered(spark, path)
    if store.exists(at(path)) and not store.rename(at(path), at(f"{path}.old")):
        raise OSError(f"{path} cannot be moved aside")
    if not store.rename(at(f"{path}.new"), at(path)):
        store.rename(at(f"{path}.old"), at(path))
        raise OSError(f"{path} cannot be replaced")
    store.delete(at(f"{path}.old"), True)


def recovered(spark: SparkSession, path: str) -> None:
    """Finishes a replacement that was cut short: what was moved aside is the table again if there is none."""
    store, at = _store(spark, path)
    if store.exists(at(f"{path}.old")):
        if store.exists(at(path)):
            store.delete(at(f"{path}.old"), True)
        elif not store.rename(at(f"{path}.old"), at(path)):
            raise OSError(f"{path} cannot be put back")


def _store(spark: SparkSession, path: str):
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def scores_by_video(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("video").parquet(path)


def chapter_markdown(chapters: DataFrame, title: str = "title") -> DataFrame:
    """book_id, markdown: chapters joined in order, image links turned to images/."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ch_idx", "text"))), lambda x: x["text"])
    return chapters.groupBy("book_id").agg(F.regexp_replace(F.array_join(listed, "\n\n"), r"\]\(figures/", "](images/").alias("markdown"))


def markdown_zips(books: DataFrame) -> DataFrame:
    """book_id, zip: each book(book_id, title, author, markdown) as an archive with YAML front matter."""

    @F.udf("binary")
    def pack(title, author, markdown):
        quoted = [f'{k}: "{(v or "").replace(chr(34), chr(92) + chr(34))}"' for k, v in (("title", title), ("author", author))]
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            info = zipfile.ZipInfo("book.md", (1980, 1, 1, 0, 0, 0))
            z.writestr(info, "---\n" + "\n".join(quoted) + "\n---\n\n" + (markdown or ""))
        return buffer.getvalue()

    return books.select("book_id", pack("title", "author", "markdown").alias("zip"))


class _Onward(io.BytesIO):
    """What follows at bytes of a file that lie elsewhere."""

    def __init__(self, at: int):
        super().__init__()
        self.at = at

    def tell(self) -> int:
        return self.at + super().tell()

    def seek(self, to: int, whence: int = io.SEEK_SET) -> int:
        return self.at + super().seek(to - self.at if whence == io.SEEK_SET else to, whence)


def _entry(file: str, body: bytes, crc: int, size: int) -> tuple[zipfile.ZipInfo, bytes]:
    """An archive's entry and the bytes that it is stored as, without compression; body is empty where it lies elsewhere."""
    info = zipfile.ZipInfo(file, (1980, 1, 1, 0, 0, 0))
    info.CRC, info.file_size, info.compress_size, info.external_attr = crc, size, size, 0o600 << 16
    return info, info.FileHeader() + body


def _xhtml(title: str, body: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body>{body}</body></html>'


def epub_parts(chapters: DataFrame) -> DataFrame:
    """book_id, at, content: the bytes of each book's archive, which is its contents in the order of at.

    chapters are (book_id, book_title, ch_idx, title, text).  A chapter is packed where it lies;
    only names and sizes come together, for what stands before and after all of a book's chapters.
    A book may be larger than a value can be.
    """

    @F.udf("struct<content:binary,crc:long,size:long>")
    def pack(ch_idx, title, text):
        paragraphs = [p.strip() for p in (text or "").split("\n\n") if p.strip()]
        body = _xhtml(title or "", "".join(f"<h1>{escape(p[2:])}</h1>" if p.startswith("# ") else f"<p>{escape(p)}</p>" for p in paragraphs)).encode()
        crc = zlib.crc32(body)
        return _entry(f"c{ch_idx}.xhtml", body, crc, len(body))[1], crc, len(body)

    @F.udf("struct<head:binary,tail:binary>")
    def frame(book, name, listed):
        files = [(f"c{c['ch_idx']}.xhtml", c["title"] or "", c["crc"], c["size"]) for c in listed]
        links = "".join(f'<li><a href="{f}">{escape(t)}</a></li>' for f, t, _, _ in files)
        nav = _xhtml("Contents", f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{links}</ol></nav>')
        items = "".join(f'<item id="i{k}" href="{f[0]}" media-type="application/xhtml+xml"/>' for k, f in enumerate(files))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(files)))
        opf = (
            '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="b"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
            f'<dc:identifier id="b">{escape(str(book))}</dc:identifier><dc:title>{escape(name or str(book))}</dc:title><dc:language>en</dc:language></metadata>'
            f'<manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{spine}</spine></package>'
        )
        container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
        head, infos, at = [], [], 0
        for file, body in (("mimetype", "application/epub+zip"), ("META-INF/container.xml", container), ("book.opf", opf), ("nav.xhtml", nav)):
            raw = body.encode()
            info, packed = _entry(file, raw, zlib.crc32(raw), len(raw))
            info.header_offset, at = at, at + len(packed)
            infos.append(info)
            head.append(packed)
        for file, _, crc, size in files:
            info, before = _entry(file, b"", crc, size)
            info.header_offset, at = at, at + len(before) + size
            infos.append(info)
        tail = _Onward(at)
        with zipfile.ZipFile(tail, "w") as z:
            z.infolist().extend(infos)
        return b"".join(head), tail.getvalue()

    # Of equal numbers and titles the digest decides.
    place = F.struct(F.lit(1).alias("part"), "ch_idx", "title", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).alias("at")
    packed = kept(chapters.select("book_id", "book_title", place, pack("ch_idx", "title", "text").alias("x")).select("book_id", "book_title", "at", "x.*"))
    listed = F.array_sort(F.collect_list(F.struct("at.ch_idx", "at.title", "at.digest", "crc", "size")))
    frames = packed.groupBy("book_id").agg(F.min("book_title").alias("name"), listed.alias("listed")).select("book_id", frame("book_id", "name", "listed").alias("x"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in packed.schema["at"].dataType.fields[1:3]]
    end = lambda part, name: F.struct(F.struct(F.lit(part).alias("part"), *none, F.lit("").alias("digest")).alias("at"), F.col(f"x.{name}").alias("content"))
    ends = F.array(end(0, "head"), end(2, "tail"))
    return packed.select("book_id", "at", "content").unionByName(frames.select("book_id", F.explode(ends).alias("e")).select("book_id", "e.*"))


def epubs(chapters: DataFrame) -> DataFrame:
    """book_id, epub: chapters(book_id, book_title, ch_idx, title, text) packaged with a navigation page, for books that fit a value."""
    return epub_parts(chapters).groupBy("book_id").agg(F.expr("listagg(content) within group (order by at)").alias("epub"))

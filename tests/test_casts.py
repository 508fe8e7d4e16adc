"""Cast analysis, EPUB archives and smaller rules, where SQL over whole tables doesn't reach."""

import io
import json
import zipfile

import pyarrow as pa
import pytest
from leafmill.functions import pytext, replies, text
from leafmill.operators import casting, narrate, proofflow
from leafmill.plans import casts
from leafmill.sources import epub
from oracle import assert_matches
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(casts.ORACLES))
def test_same_as_sql(spark, data, name):
    rows = assert_matches(spark, data, casts.QUERIES[name], casts.ORACLES[name])
    assert rows or name == "found_isbns"


def archive(files, spine, manifest, extra=""):
    items = "".join(f'<item id="{i}" href="{h}" media-type="{m}" {p}/>' for i, h, m, p in manifest)
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>The Book</dc:title><dc:creator>A. Writer</dc:creator>{extra}</metadata><manifest>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{s}{chr(34)}/>" for s in spine)}</spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in {"META-INF/container.xml": container, "OEBPS/book.opf": opf, **files}.items():
            z.writestr(name, body)
    return buffer.getvalue()


HTML = "application/xhtml+xml"


def test_archives_are_read_in_order(spark, tmp_path):
    chapters = "<?xml version='1.0'?><html><head><title>No</title></head><body><h2>One</h2><p>First words of the first chapter.</p><img src='img/a%20b.png' alt=' A  fish '/><h2>Two</h2><p>Second.</p><img src='gone.png' alt='x'/><h2>Three</h2><p>Third &amp; last.</p></body></html>"
    files = {
        "OEBPS/text/c1.xhtml": chapters, "OEBPS/text/nav.xhtml": "<h1>Contents</h1><p>One Two Three and more words</p>", "OEBPS/blank.xhtml": "<p>short</p>", "OEBPS/pic.xhtml": "<img src='../img/a%20b.png'>",
        "OEBPS/front.xhtml": "<h1>Title</h1><p>A title page with enough letters on it.</p>", "OEBPS/img/a b.png": b"\x89fish", "OEBPS/img/cover.jpg": b"cover",
    }
    manifest = [("c1", "text/c1.xhtml", HTML, ""), ("n", "text/nav.xhtml", HTML, ""), ("b", "blank.xhtml", HTML, ""), ("p", "pic.xhtml", HTML, ""), ("f", "front.xhtml", HTML, ""), ("i", "img/a%20b.png", "image/png", ""), ("cv", "img/cover.jpg", "image/jpeg", "")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.epub").write_bytes(archive(files, ["f", "n", "b", "c1", "zz", "p"], manifest, '<meta name="cover" content="cv"/>'))
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    (tmp_path / "other.txt").write_text("x")
    rows = epub.epub_files(spark, str(tmp_path)).orderBy("path", "page_ord").collect()
    bad, good = [r for r in rows if r.error], [r for r in rows if not r.error]
    assert len(bad) == 1 and bad[0].path.endswith("bad.epub") and "BadZipFile" in bad[0].error
    assert [(r.page_id, r.role, r.text) for r in good] == [
        ("p0001", "cover", None),
        ("p0002", None, "# Title\n\nA title page with enough letters on it."),
        ("p0003", None, "# One\n\nFirst words of the first chapter.\n\n![A fish](figures/p0003_a.png)"),
        ("p0004", None, "# Two\n\nSecond.\n\n"),
        ("p0005", None, "# Three\n\nThird & last."),
        ("p0006", None, "![](figures/p0006_a.png)"),
    ]
    assert bytes(good[2].figures[0].content) == b"\x89fish" and good[2].figures[0].caption == "A fish" and bytes(good[0].figures[0].content) == b"cover"
    assert {(r.title, r.author) for r in good} == {("The Book", "A. Writer")}


def test_long_archives_are_handed_on_in_parts():
    files = {f"OEBPS/c{k}.html": f"<h1>Chapter {k}</h1><p>Words enough for a page.</p>" for k in range(1200)}
    good = archive(files, [f"c{k}" for k in range(1200)], [(f"c{k}", f"c{k}.html", HTML, "") for k in range(1200)])
    odd = archive({}, [], []).replace(b"rootfile ", b"rootfils ")
    batches = list(epub._read([pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": pa.array([good, odd], pa.binary())})]))
    assert [b.num_rows for b in batches] == [500, 500, 200, 1] and batches[2].column("page_ord").to_pylist() == list(range(1000, 1200))
    assert batches[3].column("error").to_pylist()[0]


def test_pictures_beyond_the_alphabet_go(spark):
    body = "<h1>Many</h1>" + "<img src='a.png'>" * 30
    content = archive({"OEBPS/a.html": body, "OEBPS/a.png": b"p"}, ["a"], [("a", "a.html", HTML, ""), ("i", "a.png", "image/png", "")])
    pages = epub.pages_of(content)
    assert len(pages) == 1 and len(pages[0]["figures"]) == 26 and pages[0]["text"].count("![") == 26


def test_blank_pages_have_no_sections():
    assert pytext.html_chapters("<p>nineteen letters ab</p>") == [] and pytext.html_chapters("<p>twenty letters abcdefg</p>")
    assert pytext.html_chapters("<h1>A</h1><p>one</p><h1>B</h1><p>a page with words enough</p>") == ["# A\n\none", "# B\n\na page with words enough"]


@pytest.mark.parametrize("run", [casting._windows, casting._located, proofflow._edit_batches, narrate._chunks])
def test_texts_are_taken_a_few_at_a_time(run):
    """What a worker makes of a large batch comes in parts, row by row the same."""
    n, text_ = 40, "Some words. " * 30_000
    quotes = pa.array([[]] * n, pa.list_(pa.struct({"q": pa.string(), "speaker": pa.string()})))
    batch = pa.RecordBatch.from_pydict({"book_id": ["b"] * n, "ch_idx": pa.array(range(n), pa.int64()), "doc_id": pa.array(range(n), pa.int64()), "quotes": quotes, "findings": pa.array([[]] * n, pa.list_(pa.struct({"quote": pa.string()}))), "text": [text_] * n})
    parts = list(run(iter([batch])))
    key = "doc_id" if run is narrate._chunks else "ch_idx"
    assert len(parts) > 5 and list(dict.fromkeys(k for p in parts for k in p.column(key).to_pylist())) == list(range(n))


CHAPTER = "book_id string, ch_idx int, title string, text string"
ROW = f"book_id string, ch_idx int, title string, quotes {casting.QUOTES}, characters {casting.PEOPLE}, error string"


def test_windows_are_merged_in_order(spark):
    long = "\n\n".join(f"Paragraph {k} says “quote number {k} here” and more. " + "x" * 2000 for k in range(30))
    chapters = spark.createDataFrame([("b", 0, "Long", long), ("b", 1, "Kept", "text"), ("b", 2, "Bad", "nothing"), ("b", 3, "None", None)], CHAPTER)
    old = spark.createDataFrame([("b", 9, "Kept", [("old quote", "Al")], [("Al", "", "")], None), ("b", 8, "Kept", [], [], "older"), ("b", 7, "Bad", [], [], "e")], ROW)
    asked = []

    def read(windows):
        rows = windows.collect()
        asked.append(sorted((r.ch_idx, r.w) for r in rows))
        out = []
        for r in rows:
            numbers = [w for w in r.text.split() if w.isdigit()] if r.text else []
            said = {"characters": [{"name": f"W{r.w}"}], "quotes": [{"quote": f"QUOTE number {k} here", "speaker": f"S{r.w}"} for k in dict.fromkeys(numbers)]}
            out.append((r.book_id, r.ch_idx, r.w, None if r.ch_idx == 2 else json.dumps(said) if r.w != 1 else "{", "broken" if r.ch_idx == 2 else None))
        return spark.createDataFrame(out, "book_id string, ch_idx int, w int, reply string, failure string")

    got = {r.ch_idx: r for r in casting.analyse(chapters, old, read, "failed").collect()}
    assert len(asked[0]) > 5 and (1, 0) not in asked[0] and (2, 0) in asked[0]
    speakers = [q.speaker for q in got[0].quotes]
    assert speakers == sorted(speakers) and "S1" not in speakers and len(got[0].quotes) > 15 and got[0].error is None
    assert [c.name for c in got[0].characters] == sorted(c.name for c in got[0].characters)
    assert (got[1].quotes[0].q, got[1].error) == ("old quote", None) and got[2].error == "broken" and got[3].quotes == []
    got = {r.ch_idx: r for r in casting.analyse(chapters, old, read, "chapters", chapters.where("ch_idx = 2")).collect()}
    assert asked[-1] == [(2, 0)] and got[0].quotes == [] and got[0].error is None and got[1].quotes[0].speaker == "Al"


def test_people_keep_their_voices(spark):
    rows = spark.createDataFrame(
        [("b", 1, "B", [("q" * 200, "Ann"), ("said", "NARRATOR"), ("third quote", "Ann")], [("Ann", "small", ""), ("Zed", "quiet", "")], None), ("b", 0, "A", [("first quote", "Ann"), ("fourth", "Bo")], [("Ann", "", "like rain"), ("Ann", "tall", "x")], None)], ROW
    )
    old = spark.createDataFrame([("b", "Ann", "v7"), ("b", "Zed", "v1")], "book_id string, name string, voice string")
    got = {r.name: r for r in casting.people(rows, old).collect()}
    assert set(got) == {"Ann", "Bo"} and got["Bo"].voice == ""
    ann = got["Ann"]
    assert (ann.quotes, ann.description, ann.sounds_like, ann.voice) == (3, "tall", "like rain", "v7")
    assert ann.samples == ["first quote", "q" * 160, "third quote"]


def one(spark, column, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("v"))).collect()]


def test_cast_replies(spark):
    good = {"characters": [{"name": 7}, {"x": 1}, "no"], "quotes": [{"quote": "  eight ch ", "speaker": " "}, {"quote": "seven c"}, {"speaker": "A"}]}
    out = one(spark, replies.cast_reply, "```json\n" + json.dumps(good) + "```", "none", None, '{"a" ', '{"quotes": [{"quote": "long enough", "speaker": "A"}, {"name": "A"}, {"quote": "cut')
    assert [c.name for c in out[0].characters] == ["7"] and [(q.q, q.speaker) for q in out[0].quotes] == [("eight ch", "NARRATOR")] and out[0].error is None
    assert [r.error for r in out[1:4]] == ["no_json", "no_json", "no_json"]
    assert [q.speaker for q in out[4].quotes] == ["A"] and [c.name for c in out[4].characters] == ["A"] and out[4].error is None


def test_figure_boxes(spark):
    out = one(spark, replies.figure_boxes, '{"figures": [{"bbox": [-1, 0.1, 2, 0.5], "caption": null}, {"bbox": [0, 0, 0.02, 1]}, {"bbox": [1, 0, 0, 1]}, {"bbox": "x"}, {}]}', "x", '{"figures": 3}')
    assert [(b.bbox, b.caption) for b in out[0]] == [([0.0, 0.1, 1.0, 0.5], "")] and out[1] == [] and out[2] == []


def test_halves_are_joined(spark):
    cases = [(["a well-", "known man"], "a wellknown man"), (["It went", "on."], "It went on."), (["It ended.", "Then"], "It ended.\n\nThen"), (["a list", "- item"], "a list\n\n- item"), ([" ", None, "x\n"], "x"), ([], ""), (["one", "two", "# Three"], "one two\n\n# Three")]
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(cases)], "k int, p array<string>")
    assert [r[0] for r in rows.orderBy("k").select(text.join_halves(F.col("p"))).collect()] == [w for _, w in cases]


def test_labelled_numbers(spark):
    out = one(spark, text.labelled_isbns, "ISBN: 978 0 000 00000 2 and isbn – 0-00-000001-9.", "ISBN 0-00-000001-8", "978 0 000 00000 2", None)
    assert out == [["9780000000002", "0000000019"], [], [], None]

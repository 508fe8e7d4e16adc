import json
import zipfile
from io import BytesIO

from leafmill.operators import queue
from leafmill.sources import readers, sinks
from leafmill.streaming import live


def test_workspace_files(spark, tmp_path):
    ws = tmp_path / "book1"
    (ws / "pages").mkdir(parents=True)
    page = {"id": "p0001", "status": "ok", "printed_number": 3, "flags": ["blur"], "regions": [{"type": "figure", "bbox_norm": [0, 0, 1, 1]}]}
    (ws / "manifest.json").write_text(json.dumps({"version": 1, "book": {"title": "T"}, "videos": [{"id": "v0", "direction": "reverse"}], "pages": [page, {"id": "p0002"}]}, indent=1))
    (ws / "scores_v0.json").write_text(json.dumps([{"frame": "f000001.jpg", "sharpness": 2.5, "motion": 0.0, "phash": "ff"}]))
    (ws / "pages" / "p0001.md").write_text("# A\nb")
    (ws / "proof_003.json").write_text(json.dumps({"title": "A", "findings": [{"quote": "x"}]}))
    (ws / "proof_004.json").write_text("{broken")
    manifest = readers.manifests(spark, f"{ws}/manifest.json")
    rows = readers.pages(manifest).orderBy("page_ord").collect()
    assert [(r.workspace, r.page_ord, r.id, r.number_manual) for r in rows] == [("book1", 0, "p0001", False), ("book1", 1, "p0002", False)]
    assert rows[0].regions[0].type == "figure" and readers.videos(manifest).first().direction == "reverse"
    score = readers.frame_scores(spark, f"{ws}/scores_*.json").first()
    assert (score.video, score.frame_id, score.sharpness) == ("v0", "v0_f000001", 2.5)
    assert tuple(readers.page_texts(spark, f"{ws}/pages").first()) == ("p0001", "# A\nb")
    proofs = {r.ch_idx: r.title for r in readers.proofs(spark, f"{ws}/proof_*.json").collect()}
    assert proofs == {3: "A", 4: None}


def test_frame_files(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"f{n:06d}.jpg").write_bytes(bytes([n]))
    (tmp_path / "other.txt").write_text("x")
    rows = readers.frame_files(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert [(r.frame_no, bytes(r.content)) for r in rows] == [(2, b"\x02"), (10, b"\x0a")]


def test_first_filled(spark):
    a = spark.createDataFrame([("q1", "A"), ("q2", None)], "query string, title string")
    b = spark.createDataFrame([("q1", "B"), ("q2", "C"), ("q3", None)], "query string, title string")
    assert sorted(map(tuple, readers.first_filled(a, b).collect())) == [("q1", "A"), ("q2", "C")]


def test_snapshot_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.snapshot(spark.range(n), path)
    assert spark.read.parquet(path).count() == 5


def test_archives_open(spark):
    chapters = spark.createDataFrame([("b", "Book & Co", k, f"T{k}", f"# T{k}\n\nbody <{k}>") for k in (1, 0)], "book_id string, book_title string, ch_idx int, title string, text string")
    epub = zipfile.ZipFile(BytesIO(bytes(sinks.epubs(chapters).first().epub)))
    assert epub.namelist()[0] == "mimetype" and epub.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert "body &lt;0&gt;" in epub.read("c0.xhtml").decode() and epub.read("nav.xhtml").decode().index("T0") < epub.read("nav.xhtml").decode().index("T1")
    again = BytesIO()
    with zipfile.ZipFile(again, "w") as z:
        for info in epub.infolist():
            z.writestr(zipfile.ZipInfo(info.filename, (1980, 1, 1, 0, 0, 0)), epub.read(info))
    assert bytes(sinks.epubs(chapters).first().epub) == again.getvalue()
    parts = [bytes(r.content) for r in sinks.epub_parts(chapters).orderBy("at").collect()]
    assert b"".join(parts) == again.getvalue() and [p.count(b"body &lt;") for p in parts] == [0, 1, 1, 0]
    books = sinks.chapter_markdown(chapters).selectExpr("book_id", "'a \"b\"' as title", "'' as author", "markdown")
    body = zipfile.ZipFile(BytesIO(bytes(sinks.markdown_zips(books).first().zip))).read("book.md").decode()
    assert body.startswith('---\ntitle: "a \\"b\\""') and body.index("# T0") < body.index("# T1")


JOB = "id long, project long, kind string, status string"


def test_claims_respect_lanes(spark):
    rows = [(1, 1, "pipeline", "queued"), (2, 1, "reread", "queued"), (3, 1, "proof-chapter", "running"), *((n, 1, "proof-chapter", "queued") for n in range(4, 9)), (9, 1, "tts", "running"), (10, 1, "tts", "queued")]
    jobs = spark.createDataFrame(rows, JOB)
    assert sorted(r.id for r in queue.claimable(jobs).collect()) == [2, 4, 5]
    assert queue.claimable(jobs.limit(0)).count() == 0


def test_tail_keeps_its_place(spark, tmp_path):
    fields = "event_id long, user_id long, event_type string, value double"
    source, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    seen = []

    def sink(batch, epoch):
        seen.extend(r.event_id for r in batch.collect())

    for first in (0, 3):
        spark.createDataFrame([(first + k, 1, "x", 0.0) for k in range(3)], fields).coalesce(1).write.mode("append").parquet(source)
        live.each_batch(live.tail(live.read_log(spark, source, spark.read.parquet(source).schema)), sink, checkpoint)
    assert sorted(seen) == list(range(6))


def test_batches_are_claimed(spark, tmp_path):
    running = spark.createDataFrame([(1, 1, "tts", "running")], JOB)
    arrived = str(tmp_path / "jobs")
    spark.createDataFrame([(2, 1, "tts", "queued"), (3, 1, "build", "queued")], JOB).coalesce(1).write.parquet(arrived)
    stream = spark.readStream.schema(running.schema).parquet(arrived)
    live.each_batch(stream, live.claim_batch(running, str(tmp_path / "claims")), str(tmp_path / "cp"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "claims")).collect()] == [3]


def test_an_archive_of_many_entries(spark):
    chapters = spark.range(70_000).selectExpr("'b' as book_id", "'B' as book_title", "id as ch_idx", "'' as title", "if(id = 69999, 'last', '') as text")
    epub = zipfile.ZipFile(BytesIO(bytes(sinks.epubs(chapters).first().epub)))
    assert len(epub.namelist()) == 70_004 and b"<p>last</p>" in epub.read("c69999.xhtml") and epub.namelist()[4] == "c0.xhtml"


def test_kept_tables_reach_workers_in_small_batches(spark):
    from leafmill.sources.shared import kept

    def sizes(batches):
        yield from (b.from_pydict({"mb": [b.nbytes >> 20]}) for b in batches)

    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) as text").mapInArrow(sizes, "mb long")
    assert max(r.mb for r in kept(rows).collect()) < 12
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"

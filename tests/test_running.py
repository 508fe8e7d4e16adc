"""Queue, logs, the resumable stage and page mutations: what SQL over whole tables doesn't show."""

import pytest
from leafmill.operators import mutations, queue
from leafmill.sources import readers
from leafmill.streaming import accesslog, live, runner, tail
from pyspark.sql import functions as F

REQUEST = "request_id long, project long, kind string, at long"


def test_an_epoch_run_again_gives_the_same_ids(spark, tmp_path):
    jobs = spark.createDataFrame([(7, 1, "pipeline", "running"), (3, 2, "pipeline", "done")], "id long, project long, kind string, status string")
    sink, target = queue.enqueue_batches(jobs, str(tmp_path)), str(tmp_path)
    first = spark.createDataFrame([(1, 1, "pdf-import", 5), (2, 2, "pipeline", 4), (3, 2, "pipeline", 6), (4, 1, "tts", 1)], REQUEST)
    second = spark.createDataFrame([(5, 2, "epub-import", 9), (6, 9, "build", 8)], REQUEST)
    none = first.limit(0)
    rows = lambda: sorted((r.request_id, r.id, r.outcome) for r in spark.read.parquet(f"{target}/requests").collect())
    for epoch, batch in enumerate((first, none, second)):
        sink(batch, epoch)
        sink(batch, epoch)
    assert rows() == [(1, None, "busy"), (2, 9, "queued"), (3, None, "busy"), (4, 8, "queued"), (5, None, "busy"), (6, 10, "queued")]
    assert queue.enqueue(none, jobs).count() == 0


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 100 as k", "id").repartition(7)
    got = queue.numbered(rows, ["k", "id"], 40, "n").orderBy("k", "id").collect()
    assert [r.n for r in got] == list(range(41, 1041))


def write(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_silences_are_filled_while_nothing_comes(spark, tmp_path):
    schema, path = "job long, us long, id long, line string, terminal boolean", str(tmp_path / "log")
    s = 1_000_000
    batches = [[(1, 0, 1, "a", False), (1, 5 * s, 2, "b", False), (2, 0, 3, "x", False)], [(2, 100 * s, 4, "y", False)], [(1, 130 * s, 5, "c", False), (1, 130 * s, 0, None, True), (1, 131 * s, 6, "late", False)], [(1, 500 * s, 7, "no", False)]]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    seen = []
    for batch in batches:
        write(spark, [(r[0], r[1] + 1000 * s, *r[2:]) for r in batch], path, schema)
        stream = tail.follow(spark.readStream.schema(schema).parquet(path), 20, "1 second")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted((r.us // s - 1000, r.event, r.line) for r in spark.read.schema(tail.SENT).parquet(out).where("job = 1").collect()))
    beats = [(25 + 20 * k, "keepalive", None) for k in range(6)]
    assert seen[0] == [(0, "data", "a"), (5, "data", "b")]
    assert seen[1] == sorted(seen[0] + beats[:4], key=lambda x: x[:2])  # the other job's line has moved the watermark to 99 seconds
    assert seen[2] == sorted(seen[0] + beats + [(130, "data", "c"), (130, "done", None)], key=lambda x: x[:2])
    assert seen[3] == seen[2]


def test_a_stopped_stage_reads_only_the_rest(spark, tmp_path):
    todo, target, marks = str(tmp_path / "todo"), str(tmp_path / "out"), tmp_path / "marks"
    marks.mkdir()
    schema = "id long, content string"
    for k in range(4):
        write(spark, [(k * 10 + i, f"t{k * 10 + i}") for i in range(5)], todo, schema)
    stop, folder = str(tmp_path / "stop"), str(marks)
    (tmp_path / "stop").write_text("")

    def read(batches):
        import os
        import uuid

        def one(content):
            open(f"{folder}/{content}-{uuid.uuid4().hex}", "w").close()
            if content == "t3":
                raise ValueError("unreadable")
            return content.upper()

        for batch in runner.each_row(one)(batches):
            if os.path.exists(stop) and batch["id"].isin([20]).any():
                raise SystemError("pulled the plug")
            yield batch

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(todo)
    with pytest.raises(Exception, match="plug"):
        runner.run_incremental(stream(), read, target, str(tmp_path / "cp"))
    done = {r.id for r in runner.kept_results(spark.range(0), target).collect()}
    assert 0 < len(done) < 20 and 20 not in done
    before = len(list(marks.iterdir()))
    (tmp_path / "stop").unlink()
    runner.run_incremental(stream(), read, target, str(tmp_path / "cp"))
    rows = {r.id: (r.result, r.error) for r in runner.last_results(runner.kept_results(spark.range(0), target)).collect()}
    assert rows == {k * 10 + i: (f"T{k * 10 + i}", None) for k in range(4) for i in range(5)} | {3: (None, "unreadable")}
    assert len(list(marks.iterdir())) - before == 20 - len(done)
    # Another run reads what failed, if asked to, and what is new.
    write(spark, [(99, "t99")], todo, schema)
    for retry, more in ((False, 1), (True, 1)):
        before = len(list(marks.iterdir()))
        runner.run_incremental(stream(), read, target, str(tmp_path / f"cp-{retry}"), retry_failed=retry)
        assert len(list(marks.iterdir())) - before == more
    assert runner.kept_results(spark.range(0), target).count() == 22


def test_log_files_are_bounded_and_in_order(spark, tmp_path):
    lines = spark.range(500).selectExpr("id", "repeat('x', cast((id * 37) % 90 as int)) as line").repartition(5)
    sink, target = accesslog.rotating(["id"], 1000, str(tmp_path)), str(tmp_path)
    for epoch, part in enumerate((lines.where("id < 203"), lines.limit(0), lines.where("id >= 203"))):
        sink(part, epoch)
        sink(part, epoch)
    rows = accesslog.read_log(spark, target).orderBy("id").collect()
    at = 0
    for k, r in enumerate(rows):
        assert (r.id, r["from"], r.file) == (k, at, at // 1000)
        at += len(r.line) + 1
    sizes = {}
    for r in rows:
        sizes[r.file] = sizes.get(r.file, 0) + len(r.line) + 1
    assert len(rows) == 500 and max(sizes.values()) < 1000 + 90


def test_small_log_files_share_folders(spark, tmp_path):
    target = str(tmp_path)
    accesslog.rotating(["id"], 10, target)(spark.range(5000).selectExpr("id", "'12345678' as line"), 0)
    rows = accesslog.read_log(spark, target)
    assert set(rows.columns) == {"id", "line", "from", "file", "epoch"} and rows.select("file").distinct().count() == 4500
    assert rows.where("file != `from` div 10 or `from` != id * 9").count() == 0
    assert len(list(tmp_path.glob("lines/epoch=0/*/"))) == 5 and len(rows.inputFiles()) <= 5 + 200


def test_appended_rows_stay_off_the_driver(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, [(1, "a"), (2, "b")], path, "id long, x string")
    out = live.drain(spark.readStream.schema("id long, x string").parquet(path), "drained")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b")] and out.inputFiles()


def test_fallout_follows_what_is_made_from_what():
    assert mutations.fallout("reshoot") == {"md": "image", "confidence": "md", "flags": "md", "transcribe_error": "md", "regions": "md", "figures": "regions"}
    assert set(mutations.fallout("rotation")) == {"md", "confidence", "flags", "transcribe_error", "printed_number"}


REGION = "struct<type:string,bbox_norm:array<double>,caption:string,deleted:boolean,own_image:boolean,user_crop:boolean>"


def test_close_ups_keep_their_place(spark):
    r = lambda own, caption="c", deleted=False: ("figure", [0.1, 0.1, 0.5, 0.5], caption, deleted, own, None)
    cases = [[r(False), r(True), r(None)], [r(False), r(False)], [], None, [r(True, "mine", True), r(False)], [r(True)]]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"id int, regions array<{REGION}>")
    got = {x.id: x.r for x in rows.select("id", mutations.own_regions(F.col("regions")).alias("r")).collect()}
    assert [(x.deleted, x.own_image, x.caption, x.bbox_norm[2]) for x in got[0]] == [(True, False, "", 1.0), (False, True, "c", 0.5)]
    assert got[1] is None and got[2] is None and got[3] is None and got[4] is None and len(got[5]) == 1


def test_videos_are_prefixes_of_frames(spark):
    pages = spark.createDataFrame([("a", "v1_f3"), ("b", "v1_x_f3"), ("c", "v11_f3"), ("d", None), ("e", "v1")], "id string, canonical string")
    for name, kind in (("md", "string"), ("confidence", "string"), ("flags", "array<string>"), ("transcribe_error", "string"), ("printed_number", "int"), ("regions", f"array<{REGION}>"), ("figures", "array<string>")):
        pages = pages.withColumn(name, F.lit("1").cast(kind) if name in ("md", "confidence", "printed_number") else F.lit(None).cast(kind))
    videos = spark.createDataFrame([("v1", 0), ("v1_x", 0), ("v2", None)], "video string, rotate int")
    asked = spark.createDataFrame([("v1", 1, 180), ("v1_x", 1, 90), ("v1_x", 2, 0), ("v2", 1, None), ("v9", 1, 90)], "video string, seq int, rotate int")
    changed = mutations.turned(videos, asked)
    assert [tuple(x) for x in changed.collect()] == [("v1", 180)]
    out = {x.id: (x.md, x.printed_number, [c.field for c in x.cleared]) for x in mutations.rotate_videos(pages, changed).collect()}
    gone = (None, None, ["md", "confidence", "printed_number"])
    assert out == {"a": gone, "b": gone, "c": ("1", 1, []), "d": ("1", 1, []), "e": ("1", 1, [])}


def test_older_tables_gain_columns(spark):
    out = queue.migrated(spark.createDataFrame([(1, "x", 5)], "id int, kind string, other int")).first()
    assert out.asDict() == {c: d for c, (_, d) in queue.JOB.items()} | {"id": 1, "kind": "x"}


def test_readers_of_files_that_are_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.manifests(spark, f"{tmp_path}/none.json").collect()


def test_lanes_are_freed_by_what_ends(spark, tmp_path):
    fields, target = "id long, project long, kind string, status string", str(tmp_path / "claims")
    jobs = spark.createDataFrame([(1, 1, "tts", "running"), (2, 1, "tts", "queued")], fields)
    sink = live.claim_batch(jobs, target)
    batches = [[(3, 1, "tts", "queued"), (4, 1, "build", "queued")], [(1, 1, "tts", "done"), (5, 1, "build", "queued")], [(2, 1, "tts", "error"), (4, 1, "build", "canceled")], []]
    for epoch, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, fields), epoch)
        sink(spark.createDataFrame(rows, fields), epoch)
    got = sorted((r.epoch, r.id) for r in spark.read.parquet(target).collect())
    assert got == [(0, 4), (1, 2), (2, 3), (2, 5)]
    assert {r.id for r in spark.read.parquet(f"{target}-state/epoch=3").collect()} == {3, 5}


def test_complete_results_are_files_and_not_held_by_the_driver(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(100).selectExpr("id % 7 as k").write.parquet(path)
    counts = spark.readStream.schema("k long").parquet(path).groupBy("k").count()
    out = live.drain(counts, "counted", "complete")
    assert len(out.inputFiles()) > 0 and "counted" not in {t.name for t in spark.catalog.listTables()}
    assert {r.k: r["count"] for r in out.collect()} == {k: len(range(k, 100, 7)) for k in range(7)}

"""Queries over jobs, outputs, replies and streams, each with its DuckDB form where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions import replies
from leafmill.operators import outputs, queue
from leafmill.plans import fixtures as fx
from leafmill.plans.fixtures import oracle
from leafmill.sources import sinks
from leafmill.streaming import live

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LANE = "case kind when 'proof-chapter' then 'proof' when 'import' then 'import' when 'tts' then 'tts' else 'main' end"
FEW = {"few": "select * from jobs where not (status = 'running' and id % 4 > 0 and kind in ('tts', 'proof-chapter', 'import')) and not (status = 'running' and kind in ('tts', 'import'))"}


def _few(spark, sf_dir):
    return fx.jobs(spark, sf_dir).where("not (status = 'running' and id % 4 > 0 and kind in ('tts', 'proof-chapter', 'import')) and not (status = 'running' and kind in ('tts', 'import'))")


@query(oracle(f"select {LANE} as lane, count(*) as n from jobs where status = 'running' group by 1", "jobs"))
def lane_counts(spark, sf_dir):
    return queue.lane_counts(fx.jobs(spark, sf_dir))


@query(
    oracle(
        "select lane, id, project, kind from (select *, row_number() over (partition by lane order by kind = 'pipeline', id) as r from laned where status = 'queued') left join (select lane, count(*) as n from laned where status = 'running' group by 1) using (lane) where r <= (case lane when 'proof' then 3 else 1 end) - coalesce(n, 0)",
        "jobs",
        **FEW,
        laned=f"select *, {LANE} as lane from few",
    )
)
def claim_next(spark, sf_dir):
    return queue.claimable(_few(spark, sf_dir))


@query(oracle("select project, max(id) as id from jobs where status in ('queued', 'running') group by 1", "jobs"))
def active_jobs(spark, sf_dir):
    return queue.active(fx.jobs(spark, sf_dir))


@query(oracle("select id, project, kind from jobs order by id desc limit 50", "jobs"))
def jobs_list(spark, sf_dir):
    """The newest fifty jobs: the limit is the feature."""
    return fx.jobs(spark, sf_dir).orderBy(F.desc("id")).limit(50).select("id", "project", "kind")


@query(oracle("select id, case when id % 10 = 0 and status = 'queued' then 'canceled' else status end as status, id % 10 = 0 and status = 'running' as cancel from jobs", "jobs"))
def cancel_jobs(spark, sf_dir):
    jobs = fx.jobs(spark, sf_dir)
    return queue.cancelled(jobs, jobs.where("id % 10 = 0").select("id")).select("id", "status", "cancel")


@query(oracle("select id, case when status = 'running' then 'queued' else status end as status from jobs", "jobs"))
def requeue_orphans(spark, sf_dir):
    return queue.requeued(fx.jobs(spark, sf_dir)).select("id", "status")


@query(oracle("select id, case when id % 6 = 0 and status = 'running' then 'failed' else status end as status, case when id % 6 = 0 and status = 'running' then 'boom' end as error from jobs", "jobs"))
def finish_jobs(spark, sf_dir):
    jobs = fx.jobs(spark, sf_dir)
    done = jobs.where("id % 6 = 0 and status = 'running'").selectExpr("id", "'failed' as status", "'boom' as error")
    return queue.finished(jobs, done).select("id", "status", "error")


@query("select event_id as id, event_type as line from events where event_id > 500 order by event_id limit 2000")
def log_page(spark, sf_dir):
    """A page of two thousand log lines behind a cursor: the limit is the feature."""
    return queue.log_page(fx.load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("line")), 500)


SAMPLES = "select user_id as project, event_type as stage, cast(floor(epoch(ts) / 60) as bigint) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as done, 100 as total from events"


@query(
    oracle(
        "select project, stage, t, done, case when done > d0 and t > t0 then cast(floor((total - done) * (t - t0) / (done - d0)) as bigint) end as eta from (select *, min(t) over w as t0, arg_min(done, t * 100000 + done) over w as d0 from samples window w as (partition by project, stage order by t range between 89999 preceding and current row))",
        samples=SAMPLES,
    )
)
def progress_eta(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "events").selectExpr("user_id as project", "event_type as stage", "cast(floor(unix_timestamp(cast(ts as timestamp)) / 60) as bigint) as t", "row_number() over (partition by user_id, event_type order by ts, event_id) as done", "100 as total")
    return queue.progress(rows, 90000).select("project", "stage", "t", "done", "eta")


STAGES = ["extract", "score", "cluster", "select", "transcribe"]


@query("select o_custkey as project, arg_min(stage, k) as stage from (select o_custkey, o_orderkey % 5 as k, ['extract', 'score', 'cluster', 'select', 'transcribe'][o_orderkey % 5 + 1] as stage from orders where o_orderstatus <> 'F') group by 1")
def next_stage(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "orders").withColumn("stage", F.get(F.array(*map(F.lit, STAGES)), (F.col("o_orderkey") % 5).cast("int")))
    rows = rows.selectExpr("o_custkey as project", "stage", "if(o_orderstatus = 'F', 'done', 'pending') as status")
    return queue.next_stage(rows, STAGES)


@query("select o_orderkey, case when o_orderkey % 5 >= 2 then 'pending' else 'done' end as status from orders")
def reset_stages(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "orders").withColumn("stage", F.get(F.array(*map(F.lit, STAGES)), (F.col("o_orderkey") % 5).cast("int")))
    return queue.reset_from(rows.withColumn("status", F.lit("done")), "cluster", STAGES).select("o_orderkey", "status")


@query(
    "select o_custkey as book_id, o_orderkey as name, not (k = 1) as stale, case k when 0 then 'never_stamped' when 1 then '' when 2 then 'figures' when 3 then 'old_stamp' else 'book,cover' end as reasons from (select *, o_orderkey % 5 as k from orders)"
)
def output_status(spark, sf_dir):
    orders = fx.load(spark, sf_dir, "orders")
    now = "map('book', concat('b', o_custkey), 'figures', 'f', 'proofs', 'p', 'cover', 'c', 'assemble', 'a')"
    current = orders.selectExpr("o_custkey as book_id", f"{now} as parts").dropDuplicates(["book_id"])
    parts = f"case o_orderkey % 5 when 1 then {now} when 2 then map_concat(map_filter({now}, (k, v) -> k <> 'figures'), map('figures', 'old')) when 4 then map_filter({now}, (k, v) -> k not in ('book', 'cover')) end"
    files = orders.selectExpr("o_custkey as book_id", "o_orderkey as name", f"{parts} as parts", "o_orderkey % 5 as k")
    files = files.withColumn("sig", F.when(F.col("k") == 3, "0").when(F.col("k") > 0, outputs.signature("parts")))
    return outputs.output_status(files, current).select("book_id", "name", "stale", F.array_join("reasons", ",").alias("reasons"))


@query("select l_returnflag as category, count(*) as files, sum(cast(l_quantity as bigint)) as bytes from lineitem group by 1")
def storage_report(spark, sf_dir):
    files = fx.load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_quantity").cast("long").alias("bytes"))
    return outputs.storage_report(files)


@query("select 'p' || o_orderkey || '_color.png' as name from orders where o_orderstatus = 'F'")
def orphan_files(spark, sf_dir):
    orders = fx.load(spark, sf_dir, "orders")
    files = orders.selectExpr("concat('p', o_orderkey, '_color.png') as name")
    return outputs.orphans(files, orders.where("o_orderstatus <> 'F'").selectExpr("concat('p', o_orderkey) as id")).select("name")


REPLY = """concat('```json\\n', case event_id % 6
 when 0 then concat('{"markdown": "text ', event_id, '", "confidence": "high", "page_number_printed": ', event_id, ', "flags": ["blur", 3]}')
 when 1 then '{"markdown": "t", "confidence": "sure", "page_number_printed": "12", "regions": [{"bbox_norm": [0.9, -1, 0.2, 0.5]}, {"type": "x"}]}'
 when 2 then '{"markdown": 5}'
 when 3 then '{"markdown": "kept Transcribe ONLY the flat page", "confidence": "high", "flags": []}'
 when 4 then 'no braces here' else '{"markdown": "broken' end, '\\n```')"""


@query(
    """select event_id, case event_id % 6 when 0 then 'text ' || event_id when 1 then 't' when 3 then 'kept' end as markdown, case when event_id % 6 = 0 then event_id end as number,
 case event_id % 6 when 0 then 'high' when 1 then 'low' when 3 then 'low' end as confidence, case event_id % 6 when 0 then 'blur' when 1 then '' when 3 then 'prompt_echo' end as flags,
 case event_id % 6 when 1 then '0.2,0.0,0.9,0.5' when 0 then '' when 3 then '' end as boxes, case event_id % 6 when 2 then 'no_markdown' when 4 then 'no_json' when 5 then 'no_json' end as error from events"""
)
def parse_model_reply(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "events").select("event_id", replies.parse_reply(F.expr(REPLY)).alias("r"))
    boxes = F.array_join(F.transform("r.regions", lambda x: F.array_join(x["bbox_norm"].cast("array<string>"), ",")), ";")
    return rows.select("event_id", "r.markdown", F.col("r.number").cast("long").alias("number"), "r.confidence", F.array_join("r.flags", ",").alias("flags"), boxes.alias("boxes"), "r.error")


@query("""select event_id, case when event_id % 3 < 2 then 'line one' || chr(10) || '"two" ' || event_id end as markdown from events""")
def salvage_reply(spark, sf_dir):
    raw = F.expr("""if(event_id % 3 < 2, concat('{"markdown": "line one\\\\n\\\\"two\\\\" ', event_id, if(event_id % 3 = 0, '', '", "conf')), 'nothing')""")
    return fx.load(spark, sf_dir, "events").select("event_id", replies.salvage(raw).alias("markdown"))


@query("select event_id, 2 as n from events")
def salvage_findings(spark, sf_dir):
    raw = F.expr("""concat('[{"quote": "a', event_id, '"}, {"quote": "b"}, {bad}, {"quote": "c')""")
    return fx.load(spark, sf_dir, "events").select("event_id", F.size(replies.salvage_objects(raw)).alias("n"))


def _log(spark, sf_dir):
    schema = fx.load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


@query("select event_id, user_id, event_type, value from events where event_id > 100")
def log_tail_stream(spark, sf_dir):
    return live.drain(live.tail(_log(spark, sf_dir), 100), _name("tail"))


@query("select cast(date_trunc('hour', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_counts_stream(spark, sf_dir):
    rows = live.drain(live.windowed_counts(_log(spark, sf_dir)), _name("windows"), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "select user_id, min(ts) as start, max(ts) + interval 6 hour as stop, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from"
    " (select user_id, event_id, cast(ts as timestamp) as ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events)) group by user_id, s"
)
def session_stream(spark, sf_dir):
    rows = live.drain(live.sessions(_log(spark, sf_dir), "6 hours", "30 days"), _name("sessions"), "complete")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query()
def epub_files(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents")
    chapters = docs.selectExpr("source as book_id", "source as book_title", "doc_id as ch_idx", "concat('Chapter ', doc_id) as title", "text")
    return sinks.epub_parts(chapters).groupBy("book_id").agg(F.sum(F.length("content")).alias("bytes"))


@query()
def markdown_zip_files(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents").selectExpr("source as book_id", "doc_id as ch_idx", "text")
    books = sinks.chapter_markdown(docs).selectExpr("book_id", "book_id as title", "'' as author", "markdown")
    return sinks.markdown_zips(books).select("book_id", F.length("zip").alias("bytes"))

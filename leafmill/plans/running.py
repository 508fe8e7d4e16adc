"""Queries of the queue, of logs and of the resumable stage, over orders, events and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.operators import queue
from leafmill.plans import fixtures as fx
from leafmill.plans.fixtures import oracle
from leafmill.sources.shared import scratch
from leafmill.streaming import accesslog, live, runner, tail

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_REQUESTS = """
select (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as request_id, l_suppkey % 40 as project, l_shipdate as came,
 case l_partkey % 5 when 0 then 'pipeline' when 1 then 'pdf-import' when 2 then 'proof-chapter' when 3 then 'build' else 'tts' end as kind from {lineitem}"""
#: Of the jobs on the queue, those that still stand for a project.
_STANDING = "select id, project % 40 as project, kind, case when id % 3 = 0 then status else 'done' end as status from jobs"
EXCLUSIVE = "kind in ('pipeline', 'pdf-import', 'video-import', 'epub-import')"


def requests(spark, sf_dir):
    return fx._run(spark, sf_dir, _REQUESTS, "lineitem").withColumnRenamed("came", "at")


def standing(spark, sf_dir):
    return spark.sql(_STANDING.replace("jobs", "{jobs}"), jobs=fx.jobs(spark, sf_dir).where("project % 3 = 0"))


@query(
    oracle(
        f"select request_id, project, kind, case when busy then null else (select max(id) from standing) + row_number() over (partition by busy order by came, request_id) end as id, case when busy then 'busy' else 'queued' end as outcome"
        f" from (select r.*, {EXCLUSIVE} and (project in (select project from standing where {EXCLUSIVE} and status in ('queued', 'running')) or row_number() over (partition by project, {EXCLUSIVE} order by came, request_id) > 1) as busy from requests r)",
        "jobs",
        standing=_STANDING + " where project % 3 = 0",
        requests=_REQUESTS.format(lineitem="lineitem"),
    )
)
def enqueued_jobs(spark, sf_dir):
    return queue.enqueue(requests(spark, sf_dir), standing(spark, sf_dir))


@query(oracle("select id, cast(project as varchar) as project, kind, '{}' as params, '' as label, status, cast(null as varchar) as error, false as cancel from jobs", "jobs"))
def migrated_jobs(spark, sf_dir):
    return queue.migrated(fx.jobs(spark, sf_dir)).select("id", "project", "kind", "params", "label", "status", "error", "cancel")


MICROS = "timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
SILENCE = 6 * 3600


def _job_log(spark, sf_dir):
    """A user's events as the log of a job that ends with the last, or with the first purchase of some."""
    events = fx.load(spark, sf_dir, "events").selectExpr("user_id as job", f"{MICROS} as us", "event_id as id", "event_type as line")
    ends = events.groupBy("job").agg(F.coalesce(F.min(F.when((F.col("job") % 5 == 0) & (F.col("line") == "purchase"), F.col("us"))), F.max("us")).alias("us"))
    return events.withColumn("terminal", F.lit(False)).unionByName(ends.selectExpr("job", "us", "0L as id", "cast(null as string) as line", "true as terminal"))


@query(
    "with e as (select user_id as job, epoch_us(cast(ts as timestamp)) as us, event_id, event_type as line from events), t as (select job, coalesce(min(us) filter (job % 5 = 0 and line = 'purchase'), max(us)) as us from e group by 1),"
    " d as (select e.* from e join t on e.job = t.job and e.us <= t.us), g as (select job, us, lead(us) over (partition by job order by us) as nxt from (select job, us from d union select job, us from t)),"
    f" k as (select job, us + i * {SILENCE}000000 as us from (select *, unnest(range(1, 1 + (nxt - us - 1) // {SILENCE}000000)) as i from g where nxt is not null))"
    " select job, us, 'data' as event, line from d union all select job, us, 'keepalive', null from k union all select job, us, 'done', null from t"
)
def job_events_stream(spark, sf_dir):
    path = scratch(spark, "log")
    _job_log(spark, sf_dir).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return live.drain(tail.follow(stream, SILENCE), f"follow_{uuid.uuid4().hex}")


LINE = "concat('{\"ts\":', {us}, ',\"path\":\"/u/', user_id, '/', event_type, '\",\"status\":', 200 + event_id % 300, '}')"


@query(
    "select event_id, s // 4000 as file, s as from from (select event_id, cast(coalesce(sum(length(line) + 1) over (order by us, event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as s"
    " from (select *, '{\"ts\":' || us || ',\"path\":\"/u/' || user_id || '/' || event_type || '\",\"status\":' || (200 + event_id % 300) || '}' as line from (select *, epoch_us(cast(ts as timestamp)) as us from events)))".replace(" as from ", ' as "from" ')
)
def rotated_access_log(spark, sf_dir):
    """The log written by two batches, the second going on in the first one's last file."""
    rows = fx.load(spark, sf_dir, "events").selectExpr("event_id", f"{MICROS} as us", "user_id", "event_type")
    rows = rows.selectExpr("event_id", "us", LINE.replace("{us}", "us") + " as line")
    middle = rows.agg(F.expr("percentile_approx(us, 0.4)")).first()[0] or 0
    target = scratch(spark, "access")
    sink = accesslog.rotating(["us", "event_id"], 4000, target)
    for epoch, part in enumerate((rows.where(F.col("us") < middle), rows.where(F.col("us") >= middle))):
        sink(part, epoch)
    return accesslog.read_log(spark, target).select("event_id", F.col("file").cast("long").alias("file"), "from")


def _read(strong: bool):
    def read(content):
        number, text = content.split("|", 1)
        if int(number) % (49 if strong else 7) == 0:
            raise TimeoutError("timeout")
        return f"{'strong' if strong else 'first'} {len(text)}"

    return read


@query("select doc_id as id, case when doc_id % 49 = 0 then null when doc_id % 7 = 0 then 'strong ' || length(coalesce(text, '')) else 'first ' || length(coalesce(text, '')) end as result, case when doc_id % 49 = 0 then 'timeout' end as error from documents")
def resumed_stage(spark, sf_dir):
    """A stage over all documents, then another run of a stronger reader over what failed."""
    source, target = scratch(spark, "todo"), scratch(spark, "read")
    docs = fx.load(spark, sf_dir, "documents")
    docs.selectExpr("doc_id as id", "concat(doc_id, '|', coalesce(text, '')) as content").write.parquet(source)
    stream = lambda: spark.readStream.schema("id bigint, content string").option("maxFilesPerTrigger", 8).parquet(source)
    runner.run_incremental(stream(), runner.each_row(_read(False)), target, f"{target}-1")
    runner.run_incremental(stream(), runner.each_row(_read(True)), target, f"{target}-2", retry_failed=True)
    return runner.last_results(runner.kept_results(docs, target)).select("id", "result", "error")

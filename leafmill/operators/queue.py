"""A durable work queue as tables: jobs(id, project, kind, status) and an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.shared import kept

#: Columns of a job with what they are where an older table lacks them.
JOB = {
    "id": ("bigint", None), "project": ("string", None), "kind": ("string", None), "params": ("string", "{}"), "label": ("string", ""), "status": ("string", "queued"),
    "created_at": ("double", None), "started_at": ("double", None), "finished_at": ("double", None), "error": ("string", None), "result": ("string", None), "cancel": ("boolean", False),
}
LOG = "id bigint, job_id bigint, ts double, line string"
#: Kinds of which a project has one at most at a time.
EXCLUSIVE = ("pipeline", "pdf-import", "video-import", "epub-import")
#: The lane of each kind of job, and how many of a lane run at once.
LANES = {
    "proof-chapter": "proof", "cast-analysis": "proof", "pdf-import": "import", "video-import": "import", "epub-import": "import",
    "import": "import", "audiobook": "tts", "tts-preview": "tts", "voice-gen": "tts", "voice-gen-all": "tts", "tts": "tts",
}
CAPS = {"main": 1, "proof": 3, "import": 1, "tts": 1}


def _lookup(key: Column, table: dict, default) -> Column:
    value = F.lit(default)
    for k, v in table.items():
        value = F.when(key == k, F.lit(v)).otherwise(value)
    return value


def lane(kind: str = "kind") -> Column:
    return _lookup(F.col(kind), LANES, "main")


def lane_counts(jobs: DataFrame, partition: str | None = None) -> DataFrame:
    """lane, n of the running jobs."""
    return jobs.where("status = 'running'").groupBy(lane().alias("lane")).agg(F.count("*").alias("n"))


def claimable(jobs: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Queued jobs that may start now, each lane up to its cap: short jobs before pipelines, then by id."""
    rows = jobs.where("status = 'queued'").withColumn("lane", lane())
    w = Window.partitionBy("lane").orderBy(F.col("kind") == "pipeline", "id")
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(caps.values(), default=0))
    rows = rows.join(lane_counts(jobs), "lane", "left")
    free = _lookup(F.col("lane"), caps, 1) - F.coalesce("n", F.lit(0))
    return rows.where(F.col("r") <= free).select("lane", "id", "project", "kind")


def active(jobs: DataFrame) -> DataFrame:
    """project, id: the latest queued or running job of each project."""
    return jobs.where("status in ('queued', 'running')").groupBy("project").agg(F.max("id").alias("id"))


def cancelled(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """jobs after cancelling ids(id): queued ones end at once, running ones are flagged, ended ones stay."""
    rows = jobs.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    flag = F.coalesce(F.col("hit") & (F.col("status") == "running"), F.lit(False))
    return rows.withColumn("cancel", flag).withColumn("status", F.when(F.col("hit") & (F.col("status") == "queued"), "canceled").otherwise(F.col("status"))).drop("hit")


def requeued(jobs: DataFrame) -> DataFrame:
    """jobs after a restart: what was running waits again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs with the state of results(id, status, error); others stay."""
    rows = jobs.join(results.withColumnsRenamed({"status": "new_status", "error": "new_error"}), "id", "left")
    return rows.withColumn("status", F.coalesce("new_status", "status")).withColumnRenamed("new_error", "error").drop("new_status")


def log_page(log: DataFrame, after: int, limit: int = 2000) -> DataFrame:
    """The next limit lines of the log(id, ...) after a cursor."""
    return log.where(F.col("id") > after).orderBy("id").limit(limit)


def progress(samples: DataFrame, window: int = 900) -> DataFrame:
    """samples(project, stage, t seconds, done, total) with eta in seconds from the rate of the last window seconds.

    The rate is that between the first and the last sample of the stage in the window; null
    without progress.
    """
    w = Window.partitionBy("project", "stage").orderBy("t").rangeBetween(-window + 1, 0)
    span, made = F.col("t") - F.first("t").over(w), F.col("done") - F.first("done").over(w)
    rows = samples.withColumn("span", span).withColumn("made", made)
    eta = F.when((F.col("made") > 0) & (F.col("span") > 0), F.floor((F.col("total") - F.col("done")) * F.col("span") / F.col("made")).cast("long"))
    return rows.withColumn("eta", eta).drop("span", "made")


def next_stage(stages: DataFrame, order: list[str]) -> DataFrame:
    """project, stage: each project's first stage in order that isn't done."""
    rows = stages.where("status <> 'done'").withColumn("k", _lookup(F.col("stage"), {s: i for i, s in enumerate(order)}, len(order)))
    return rows.groupBy("project").agg(F.min_by("stage", "k").alias("stage"))


def reset_from(stages: DataFrame, stage: str, order: list[str]) -> DataFrame:
    """stages with stage and all after it pending."""
    later = order[order.index(stage) :]
    return stages.withColumn("status", F.when(F.col("stage").isin(later), "pending").otherwise(F.col("status")))


def migrated(jobs: DataFrame) -> DataFrame:
    """jobs with every column of JOB: those that an older table lacks have their default, others are left out."""
    return jobs.select(*((F.col(c).cast(t) if c in jobs.columns else F.lit(default).cast(t)).alias(c) for c, (t, default) in JOB.items()))


def in_order(rows: DataFrame, order: list[str], tasks: int | None = None) -> DataFrame:
    """rows in a global order, kept, with the partition (``__part``) and a growing number (``__row``) of each."""
    placed = rows.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order)
    return kept(placed.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))


def with_next(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with the columns of the next row of the same keys, each under its name and 2, null for the last.

    The order is that of a range shuffle, so no task has all rows of a key; the next of a
    partition's last row is the first of a later one, of which there is a row for each partition.
    """
    others = [c for c in rows.columns if c not in keys]
    placed = in_order(rows, [*keys, order])
    every = F.struct(*rows.columns)
    firsts = placed.groupBy("__part").agg(F.min_by(every, "__row").alias("__first"))
    firsts = firsts.select("__part", F.lead("__first").over(Window.orderBy("__part")).alias("__later"))
    found = placed.withColumn("__next", F.lead(every).over(Window.partitionBy("__part").orderBy("__row"))).join(F.broadcast(firsts), "__part")
    found = found.withColumn("__next", F.coalesce("__next", "__later"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__next.{key}"))
    return found.select(*rows.columns, *(F.when(same, F.col(f"__next.{c}")).alias(f"{c}2") for c in others))


def numbered(rows: DataFrame, order: list[str], after: int, name: str = "id") -> DataFrame:
    """rows with consecutive numbers in order, from after + 1: places in a partition behind what earlier ones hold."""
    placed = in_order(rows, order)
    held = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = held.select("__part", (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__shift"))
    number = F.lit(after + 1).cast("long") + F.col("__row") + F.col("__shift")
    return placed.join(F.broadcast(starts), "__part").withColumn(name, number).drop("__part", "__row", "__shift")


def admitted(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests(request_id, project, kind, at) with busy: an exclusive job of the project waits or runs, or came first."""
    exclusive = F.col("kind").isin(*EXCLUSIVE)
    held = jobs.where(exclusive & F.col("status").isin("queued", "running")).select("project", F.lit(True).alias("__held")).distinct()
    first = requests.where(exclusive).groupBy("project").agg(F.min(F.struct("at", "request_id"))["request_id"].alias("__first"))
    rows = requests.join(held, "project", "left").join(first, "project", "left")
    return rows.withColumn("busy", exclusive & (F.coalesce("__held", F.lit(False)) | (F.col("request_id") != F.col("__first")))).drop("__held", "__first")


def enqueue(requests: DataFrame, jobs: DataFrame, after: int | None = None) -> DataFrame:
    """request_id, project, kind, id, outcome: those admitted get the next ids in order of arrival, the others none.

    after is the last id given so far; by default that of jobs.  A request that asks for what a
    project may have only once, while it has it, is busy.
    """
    after = (jobs.agg(F.max("id")).first()[0] or 0) if after is None else after
    rows = admitted(requests, jobs)
    queued = numbered(rows.where("not busy"), ["at", "request_id"], after)
    refused = rows.where("busy").withColumn("id", F.lit(None).cast("long"))
    return queued.unionByName(refused).select("request_id", "project", "kind", "id", F.when(F.col("busy"), "busy").otherwise("queued").alias("outcome"))


def enqueue_batches(jobs: DataFrame, target: str):
    """A foreachBatch sink, the single writer, that gives each epoch's requests their ids.

    An epoch writes its outcomes and, last, the last id it gave; run again it gives the same
    ids, since it starts from the end of the epoch before and looks only at earlier epochs' jobs.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        after = spark.read.parquet(f"{target}/ends/epoch={epoch - 1}").first()["id"] if epoch else (jobs.agg(F.max("id")).first()[0] or 0)
        known = jobs.select("id", "project", "kind", "status")
        if epoch:
            own = spark.read.parquet(f"{target}/requests").where((F.col("epoch") < epoch) & (F.col("outcome") == "queued"))
            now = own.select("id", "project", "kind", F.lit("queued").alias("status")).join(jobs.select("id"), "id", "left_anti")
            known = known.unionByName(now)
        enqueue(batch, known, after).write.mode("overwrite").parquet(f"{target}/requests/epoch={epoch}")
        end = spark.read.parquet(f"{target}/requests/epoch={epoch}").agg(F.coalesce(F.max("id"), F.lit(after)).cast("long").alias("id"))
        end.coalesce(1).write.mode("overwrite").parquet(f"{target}/ends/epoch={epoch}")

    return sink

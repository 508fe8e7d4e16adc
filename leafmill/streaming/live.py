"""Structured Streaming forms of the log tail, rest-frame counts, progress and claiming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import queue
from leafmill.sources.shared import scratch


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """An append-only log of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tail(log: DataFrame, after: int = -1) -> DataFrame:
    """Log lines behind a cursor; the sink's checkpoint keeps the place from then on."""
    return log.where(F.col("event_id") > after).select("event_id", "user_id", "event_type", "value")


def windowed_counts(log: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """start, event_type, n, total per event-time window; rows later than late are dropped by the watermark."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, stop, n: a user's events without a gap that long."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its rows.

    Rows go to Parquet files in the shared folder: those that are appended as they come, and
    complete results each epoch anew, of which the last counts.  Updated aggregates, which are
    small, go to a table in memory.
    """
    spark = stream.sparkSession
    path = scratch(spark, name)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    if mode == "complete":
        last: list[int] = []

        def store(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
            last[:] = [epoch]

        writer.foreachBatch(store).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/epoch={last[0]}") if last else spark.createDataFrame([], stream.schema)
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every micro-batch to sink(batch, epoch); the epoch lets the sink skip what it has written."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def claim_batch(jobs: DataFrame, target: str) -> Callable[[DataFrame, int], None]:
    """A sink that, as the single writer, adds an epoch's claimable jobs to the table at target.

    A batch has new jobs and news of old ones, (id, project, kind, status); of several rows of one
    id the furthest on counts.  What is claimed runs until news of its end frees its lane.  An
    epoch reads only the state that the one before left at target-state, the jobs that wait or
    run, and jobs before the first; an epoch that is run again replaces its own claims and state.
    """
    names = ["id", "project", "kind", "status"]
    stage = F.when(F.col("status") == "queued", 0).when(F.col("status") == "running", 1).otherwise(2)

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(jobs.select(names).schema).parquet(f"{target}-state/epoch={epoch - 1}") if epoch else jobs.select(names)
        now = before.unionByName(batch.select(names)).groupBy("id").agg(F.max_by(F.struct("project", "kind", "status"), stage).alias("j")).select("id", "j.*")
        claims = f"{target}/epoch={epoch}"
        queue.claimable(now).write.mode("overwrite").parquet(claims)
        taken = spark.read.schema("lane string, id long").parquet(claims).select("id", F.lit(True).alias("taken"))
        status = F.when(F.col("taken"), "running").otherwise(F.col("status"))
        left = now.join(taken, "id", "left").withColumn("status", status).where("status in ('queued', 'running')").select(names)
        left.write.mode("overwrite").parquet(f"{target}-state/epoch={epoch}")

    return sink

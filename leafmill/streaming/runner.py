"""A long stage that survives being stopped: results and failures are kept row group by row group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def each_row(read: Callable[[object], str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over (id, content): (id, result, error); a row that fails is a row, not the end of the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for content in batch["content"]:
                try:
                    results.append(read(content))
                    errors.append(None)
                except Exception as e:  # whatever the reader raises is this row's result
                    results.append(None)
                    errors.append(str(e)[:300] or type(e).__name__)
            yield pd.DataFrame({"id": batch["id"], "result": results, "error": errors})

    return run


RESULT = "id bigint, result string, error string"


def kept_results(todo: DataFrame, target: str) -> DataFrame:
    """All rows that any run has kept: RESULT, run, epoch; empty before the first."""
    spark = todo.sparkSession
    schema = RESULT + ", run string, epoch bigint"
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def last_results(kept: DataFrame) -> DataFrame:
    """One row an id: a result if there is one, else the failure; of several the one of the last run by name and epoch."""
    w = Window.partitionBy("id").orderBy(F.col("error").isNotNull(), F.desc("run"), F.desc("epoch"))
    return kept.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "epoch")


def run_incremental(todo: DataFrame, read: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], target: str, checkpoint: str, retry_failed: bool = False) -> None:
    """Runs read over the stream todo(id, content) until nothing is left, keeping each micro-batch at target.

    The same checkpoint goes on where it was stopped: a batch that was being read is read again
    and replaces what it had written.  Another checkpoint is another run, which leaves out rows
    that earlier runs have results for, and unless retry_failed those that failed; that is one
    anti-join a batch with the earlier runs' ids, which don't grow while it runs.  A run's files
    are named by its checkpoint.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    spark = todo.sparkSession
    before = kept_results(todo, target).where(F.col("run") != run)
    finished = before.where("error is null").select("id") if retry_failed else before.select("id")

    def sink(batch: DataFrame, epoch: int) -> None:
        rest = batch.select(F.col("id").cast("long").alias("id"), "content").join(finished.distinct(), "id", "left_anti")
        rest.mapInPandas(read, RESULT).write.mode("overwrite").parquet(f"{target}/run={run}/epoch={epoch}")

    todo.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark.catalog.refreshByPath(target)

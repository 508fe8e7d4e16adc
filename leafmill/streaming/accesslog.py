"""An append-only log dealt to files of bounded size.

A row has the file of its line.  What is stored is a folder for each stretch of FILES files,
sorted by file and place, so that a large log of small files isn't as many folders to list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.queue import in_order

#: Files of the log to a stored folder.
FILES = 1024

def deal(lines: DataFrame, order: list[str], cap: int, start: int = 0) -> DataFrame:
    """lines(line) with from, the bytes before each, a line's end counting one, and file = from // cap.

    A file has all lines that begin within its stretch of cap bytes, so it is over cap by less
    than a line, and files in order of their number hold the lines in order.  The sum runs
    within partitions of a range shuffle and over the partitions' totals.
    """
    placed = in_order(lines.withColumn("__bytes", F.octet_length("line") + 1), order)
    totals = placed.groupBy("__part").agg(F.sum("__bytes").alias("__total"))
    earlier = F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = totals.select("__part", F.coalesce(earlier, F.lit(0)).alias("__start"))
    within = F.sum("__bytes").over(Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1))
    rows = placed.withColumn("__within", F.coalesce(within, F.lit(0))).join(F.broadcast(starts), "__part")
    rows = rows.withColumn("from", F.lit(start) + F.col("__start") + F.col("__within"))
    return rows.withColumn("file", F.floor(F.col("from") / cap).cast("long")).drop("__part", "__row", "__bytes", "__start", "__within")


def rotating(order: list[str], cap: int, target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that goes on where the batch before has ended.

    Each epoch writes its lines by file and, last, where it ended; run again it replaces both,
    starting from the end of the epoch before.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        start = spark.read.parquet(f"{target}/ends/epoch={epoch - 1}").first()["end"] if epoch else 0
        rows = deal(batch, order, cap, start)
        rows = rows.withColumn("folder", F.floor(F.col("file") / FILES).cast("long")).sortWithinPartitions("folder", "file", "from")
        rows.write.mode("overwrite").partitionBy("folder").parquet(f"{target}/lines/epoch={epoch}")
        end = spark.read.parquet(f"{target}/lines/epoch={epoch}").agg(F.max(F.col("from") + F.octet_length("line") + 1).alias("end")) if not batch.isEmpty() else None
        end = end if end is not None else spark.range(1).select(F.lit(start).cast("long").alias("end"))
        end.coalesce(1).write.mode("overwrite").parquet(f"{target}/ends/epoch={epoch}")

    return sink


def read_log(spark, target: str) -> DataFrame:
    """All lines with their file and place."""
    return spark.read.option("basePath", f"{target}/lines").parquet(f"{target}/lines").drop("folder")

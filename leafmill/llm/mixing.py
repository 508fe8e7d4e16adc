"""Mixing sources to target weights by systematic sampling.

Sources share a total of words by their weights; a source's share stops at ``cap`` times its
size and the excess goes to the others by weight.  A document's expected copies are its
source's target over its source's size.  Within a source, documents stand in order of size;
their expected copies are prefix-summed, one random offset a source is added, and a document
is taken once for every integer that its stretch of the sum crosses.  So no document is taken
more often than its rate rounded up, and, as neighbours are of like size, the words taken
differ from the target by about the largest document at most.

The order is made by one range shuffle, so that a source with a third of all rows is many
partitions; prefix sums are places within a partition plus what earlier partitions hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import removed, written
from leafmill.llm.wordcols import fits_broadcast

#: Steps of a source's random offset: few bits, so that sums stay exact in double precision.
OFFSETS = 1024
#: Fixed values of the mix: weights by a source's place, per cent of all words, most copies.
WEIGHTS, PERCENT, CAP = (3, 1, 2), 150, 2


def blank_separated_words(text: Column) -> Column:
    """Number of words between blanks and control blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in a global order, written, with the partition (``__part``) and a growing number (``__row``) of each."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "placed")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) of sizes(source, source_size), one row a source.

    Sources in order of their code points, null last, have the weights in turn, again and again.
    They share percent/100 of all sizes; where a target passes cap times its source's size it
    stops there, and what is over goes to the others by weight, until none is above.
    """
    placed = _places(sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"])
    starts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = starts.withColumn("__before", F.coalesce(earlier, F.lit(0)))
    place = F.col("__before") + F.col("__row") - F.col("__first")
    turn = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    rated = written(placed.join(F.broadcast(starts), "__part").select("source", "source_size", turn.alias("weight")), "sources")
    removed(placed)
    # A source is at its cap where cap * size <= level * weight; the level only rises as sources reach theirs.
    over, under = 1, 0
    capped = F.lit(False)
    while True:
        full = F.col("source_size") == 0
        if under:
            full = full | (F.col("source_size").cast("decimal(38,0)") * F.lit(100 * cap * under) < F.col("weight").cast("decimal(38,0)") * F.lit(over))
        row = rated.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).cast("long").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).cast("long").alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).cast("long").alias("weight"),
        ).first()
        new_over, new_under = percent * row["all"] - 100 * cap * row["full"], row["weight"]
        capped = full
        if not new_under or (new_over, new_under) == (over, under):
            break
        over, under = new_over, new_under
    share = (F.lit(over) * F.col("weight")).cast("double") / F.lit(float(100 * under or 1))
    target = F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(share)
    return rated.select("source", "source_size", "weight", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in (0, 1): the same for the same seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit(""))).cast("binary"))
    return (F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(OFFSETS)).cast("double") + 0.5) / OFFSETS


def mix_copies(docs: DataFrame, size: Column, carry: list[str], weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP, seed: int = 0) -> DataFrame:
    """The carried columns of each document with size, source_size, target and copies (long).

    docs needs doc_id, text and source.  Null texts have size 0, and null sources are one source,
    the last.  Very long texts count whole.  Documents of one source and size go by doc_id, null
    first, so equal rows are interchangeable; repeated rows are taken each on its own.  Carried
    columns may have any names; others are ignored.  An empty table gives no rows, and a source
    without words is taken with target 0 and no copies.
    """
    kept = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))).alias("__carried"), F.col("doc_id").alias("__id"), F.col("source"), size.cast("long").alias("size"))
    placed = _places(kept, ["source", "size", "__id"])
    held = placed.groupBy("__part", "source").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"), F.sum("size").alias("__size"))
    held = written(held, "held")
    targets = source_targets(held.groupBy("source").agg(F.sum("__size").cast("long").alias("source_size")), weights, percent, cap)
    earlier = F.sum("__n").over(Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.withColumn("__before", F.coalesce(earlier, F.lit(0)))
    starts = starts.alias("h").join(targets.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source"))).select("h.source", "__part", "__before", "__first", "source_size", "target")
    starts = written(starts, "starts")
    if fits_broadcast(starts, "source"):
        starts = F.broadcast(starts)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("__before") + F.col("__row") - F.col("__first")
    crossed = lambda n: F.floor(n.cast("double") * rate + offset(F.col("p.source"), seed))
    joined = placed.alias("p").join(starts.alias("s"), (F.col("p.__part") == F.col("s.__part")) & F.col("p.source").eqNullSafe(F.col("s.source")))
    copies = F.least(crossed(place + 1) - crossed(place), F.lit(cap)).cast("long")
    named = [F.col(f"__carried.c{i}").alias(c) for i, c in enumerate(carry)]
    return joined.select(*named, "size", "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP, seed: int = 0) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with all columns as they were."""
    taken = mix_copies(docs, blank_separated_words(F.col("text")), docs.columns, weights, percent, cap, seed)
    inner = taken.toDF(*(f"__{i}" for i in range(len(taken.columns)))).where(F.col(f"__{len(docs.columns) + 3}") > 0)
    repeated = inner.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(f"__{len(docs.columns) + 3}"))))
    return repeated.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))

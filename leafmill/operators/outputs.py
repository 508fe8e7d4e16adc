"""What a built file was made from, whether it is stale, and what a workspace holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components in the order in which reasons are given.
COMPONENTS = ("book", "figures", "proofs", "cover", "assemble")


def fingerprint(*parts: str) -> Column:
    """12 hex digits of the components' digest."""
    return F.substring(F.sha1(F.concat_ws("\n", *parts).cast("binary")), 1, 12)


def signature(parts: str = "parts") -> Column:
    """16 hex digits of all component fingerprints in a map, in the order of COMPONENTS."""
    listed = [F.coalesce(F.col(parts)[c], F.lit("")) for c in COMPONENTS]
    return F.substring(F.sha1(F.concat_ws("|", *listed).cast("binary")), 1, 16)


def output_status(files: DataFrame, current: DataFrame) -> DataFrame:
    """book_id, name, stale, reasons of files(book_id, name, sig, parts) against current(book_id, parts).

    Three kinds of stamps: with sig and parts the changed components are named, or 'state' if
    none differs; with sig alone 'old_stamp'; without any 'never_stamped'.
    """
    now = current.select("book_id", F.col("parts").alias("now"), signature("parts").alias("now_sig"))
    rows = files.join(now, "book_id", "left")
    changed = F.filter(F.array(*(F.when(~F.col("parts")[c].eqNullSafe(F.col("now")[c]), F.lit(c)) for c in COMPONENTS)), lambda x: x.isNotNull())
    stale = ~F.coalesce(F.col("sig") == F.col("now_sig"), F.lit(False))
    reasons = (
        F.when(F.col("sig").isNull(), F.array(F.lit("never_stamped")))
        .when(~stale, F.array().cast("array<string>"))
        .when(F.col("parts").isNull(), F.array(F.lit("old_stamp")))
        .when(F.size(changed) == 0, F.array(F.lit("state")))
        .otherwise(changed)
    )
    return rows.select("book_id", "name", stale.alias("stale"), reasons.alias("reasons"))


def storage_report(files: DataFrame) -> DataFrame:
    """category, files, bytes of files(category, bytes)."""
    return files.groupBy("category").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def orphans(files: DataFrame, pages: DataFrame) -> DataFrame:
    """files(name) whose page id, the part before the first underscore, is not among pages(id)."""
    return files.withColumn("id", F.substring_index("name", "_", 1)).join(pages.select("id"), "id", "left_anti")

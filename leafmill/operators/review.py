"""Review predicates and work queues over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: flags that send a page to the stronger reader.
ESCALATION_FLAGS = ("cut_off_text", "blur", "multi_column", "handwriting", "prompt_echo")


def needs_escalation(on: tuple[str, ...] = ("malformed_json", "low_confidence", "flags")) -> Column:
    """Whether a reading (transcribe_error, confidence, flags) is worth a second, stronger one."""
    failed = F.col("transcribe_error").isNotNull()
    low = F.lit("low_confidence" in on) & (F.col("confidence") == "low")
    flagged = F.lit("flags" in on) & F.arrays_overlap("flags", F.array(*map(F.lit, ESCALATION_FLAGS)))
    return F.when(failed, F.lit("malformed_json" in on)).otherwise(F.coalesce(low, F.lit(False)) | F.coalesce(flagged, F.lit(False)))


def suspect_after_reading() -> Column:
    odd = (F.col("confidence") == "low") | F.exists("flags", lambda f: f != "multi_column")
    return F.coalesce(odd, F.lit(False)) & ~F.col("suspect_ignored")


def uncropped() -> Column:
    return F.col("has_region") & ~F.col("has_crop")


def needs_reshoot_work() -> Column:
    """A structural problem that neither a crop nor 'looks fine' settles."""
    return (
        F.col("transcribe_error").isNotNull() | F.col("needs_reshoot") | F.col("number_rejected") | F.col("number_conflict")
        | (F.col("status") == "missing") | (F.col("has_region") & F.col("stale_crop"))
    )


def reasons() -> Column:
    """Codes of what speaks against a page, in their fixed order; ignoring waives the reader's complaints only."""
    ignored = F.col("suspect_ignored")
    rules = [
        (F.col("transcribe_error").isNotNull(), "read_failed"),
        (~ignored & (F.col("confidence") == "low"), "low_confidence"),
        (~ignored & F.array_contains("flags", "blur"), "flag:blur"),
        (~ignored & F.array_contains("flags", "cut_off_text"), "flag:cut_off_text"),
        (~ignored & F.array_contains("flags", "multi_column"), "note:multi_column"),
        (~ignored & F.col("figure_quality"), "figure_quality"),
        (F.col("needs_reshoot"), "marked"),
        (F.col("has_region") & F.col("stale_crop"), "stale_crop"),
        (F.col("number_rejected"), "number_rejected"),
        (F.col("number_conflict"), "number_conflict"),
        (uncropped(), "no_crop"),
    ]
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in rules)), lambda x: x.isNotNull())
    found = F.when((F.size(found) == 0) & (F.col("status") == "suspect") & ~ignored, F.array(F.lit("poor_capture"))).otherwise(found)
    return F.when(F.col("status") == "missing", F.concat(found, F.array(F.lit("missing")))).otherwise(found)


def work_queues(pages: DataFrame) -> DataFrame:
    """book_id, page_ord, queue, reasons: re-reading, cropping and reshooting, each page in one at most."""
    live = pages.where("status not in ('duplicate', 'deleted')").withColumn("all", reasons())
    real = F.filter("all", lambda x: ~x.startswith("note:") & (x != "no_crop"))
    queue = (
        F.when(F.col("transcribe_error").isNotNull(), "reread")
        .when(uncropped() & ~needs_reshoot_work(), "crop")
        .when(F.size(real) > 0, "reshoot")
    )
    rows = live.withColumn("queue", queue).where("queue is not null")
    return rows.select("book_id", "page_ord", "queue", F.when(F.col("queue") == "reshoot", F.array_join(real, ",")).otherwise(F.lit("")).alias("reasons"))

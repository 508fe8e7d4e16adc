"""Readers of a workspace's files with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE = "frame string, sharpness double, flatness double, occlusion double, motion double, phash string, quad array<array<double>>"
REGION = "struct<type:string,bbox_norm:array<double>,caption:string,deleted:boolean,needs_reshoot:boolean,stale_crop:boolean>"
PAGE = (
    "id string, video string, cluster_frames array<string>, canonical string, fallback string, "
    "scores struct<composite:double,sharpness:double,flatness:double,occlusion:double,motion:double>, status string, "
    "printed_number int, number_manual boolean, number_inferred boolean, number_rejected boolean, number_conflict boolean, "
    f"confidence string, flags array<string>, transcribe_error string, md string, regions array<{REGION}>, figures array<string>, "
    "role string, pinned string, patched_source string, source string, section string, dedupe_exempt boolean, "
    "manual_duplicate boolean, suspect_ignored boolean, needs_reshoot boolean"
)
VIDEO = "id string, path string, direction string, rotate int, fps_actual double, nb_frames long, width int, height int, duration double"


MANIFEST = f"version int, created_at string, book struct<title:string,author:string,isbn:string,publisher:string,year:string,expected_pages:int>, videos array<struct<{VIDEO}>>, pages array<struct<{PAGE}>>"
PROOF = "title string, base_hash string, status string, proofed_md string, heavy boolean, applied int, findings array<struct<type:string,severity:string,quote:string,replacement:string,note:string,source:string,apply_all:boolean,reference:boolean,user_edit:boolean,rejected:boolean,applied:boolean,skip_reason:string>>"
ACCESS = "ts double, method string, path string, status int, ms double"


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """path, frame_no, modified, content of frame images, numbered by their names."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "f*.jpg").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.regexp_extract("path", r"f(\d+)\.jpg$", 1).try_cast("int").alias("frame_no"), F.col("modificationTime").alias("modified"), "content")


def frame_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score records of all videos, one JSON array a file named scores_VIDEO.json; frame_id joins both names."""
    rows = spark.read.schema(SCORE).option("multiLine", True).json(path)
    return with_frame_ids(rows.withColumn("video", F.regexp_extract(F.col("_metadata.file_name"), r"scores_(.+)\.json$", 1)))


def with_frame_ids(rows: DataFrame) -> DataFrame:
    """Score records with frame_id, their video's and their frame's name."""
    return rows.withColumn("frame_id", F.concat_ws("_", "video", F.regexp_replace("frame", r"\.jpg$", "")))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per workspace manifest."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("workspace", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def pages(manifest: DataFrame) -> DataFrame:
    """workspace, page_ord and the page fields; missing flags read as false."""
    rows = manifest.select("workspace", F.posexplode("pages").alias("page_ord", "page")).select("workspace", "page_ord", "page.*")
    return rows.fillna(False)


def videos(manifest: DataFrame) -> DataFrame:
    return manifest.select("workspace", F.posexplode("videos").alias("video_ord", "v")).select("workspace", "video_ord", "v.*")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """workspace-relative page id and its whole text."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"(.+)\.md$", 1).alias("page_id"), F.col("value").alias("text"))


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """Proof files proof_NNN.json; a corrupt file is a row of nulls."""
    rows = spark.read.schema(PROOF).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("ch_idx", F.regexp_extract(F.col("_metadata.file_name"), r"proof_(\d+)", 1).try_cast("int"))


def access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCESS).json(path)


def first_filled(*sources: DataFrame) -> DataFrame:
    """Rows of the first source that has any for a query: each needs query and rank, later ones only fill gaps."""
    found = sources[0].where("title is not null")
    for other in sources[1:]:
        found = found.unionByName(other.where("title is not null").join(found.select("query").distinct(), "query", "left_anti"))
    return found

"""The corpus pipeline: language ID, quality, near-duplicates, decontamination, packing.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import is_split, written
from leafmill.llm.decontaminate import contamination
from leafmill.llm.lang_id import learn_languages, predict_languages
from leafmill.llm.near_dup import near_duplicates
from leafmill.llm.packing import pack_documents
from leafmill.llm.quality import learn_quality, predict_quality
from leafmill.llm.queries import table, vocabulary

#: A text whose best language has less than this probability is rejected, as ``und`` is.
LEAST_LANGUAGE_SCORE = 0.5


def _apart(docs: DataFrame) -> DataFrame:
    """docs with its columns but doc_id and text named by place, so that a stage's own columns meet no namesake."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a recognisable language.

    Null, empty and letterless texts go, as they have none; very long ones are read whole.
    Repeated rows and rows without doc_id are judged by their text like any other.  All columns
    come back unchanged, whatever their names; an empty table gives an empty one, and one
    without labelled languages loses all rows.
    """
    model = learn_languages(docs, ~is_split("doc_id", 4, 2))
    rows = _apart(docs)
    rated = predict_languages(rows, model)
    return rated.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(rows.columns).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the quality classifier predicts to be of label 0.

    A null text counts as an empty one, which is scored like any other, as very long ones are.
    Repeated rows and rows without doc_id are judged by their text.  All columns come back
    unchanged, whatever their names; an empty table gives an empty one.
    """
    trees = learn_quality(docs, table(spark, sf_dir, "labels"), ~is_split("doc_id", 4, 2))
    rows = _apart(docs)
    return predict_quality(rows, trees).where("predicted = 1").select(rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that of the smallest doc_id.

    Rows without doc_id belong to no class and pass, as they do in decontamination.  Of the rows
    of one kept doc_id one stays.  Null and empty texts are in no class with others and stay.
    All columns come back unchanged, whatever their names; an empty table gives an empty one.
    """
    columns = docs.columns
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    found = docs.join(kept, "doc_id", "left_semi")
    once = found.join(repeated, "doc_id", "left_anti")
    one = found.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return docs.where("doc_id is null").unionByName(once.select(columns)).unionByName(one.select(columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents contaminated with benchmark passages.

    Null and empty texts hold none and stay; all rows of a contaminated doc_id go; rows without
    doc_id aren't looked at and stay.  All columns come back unchanged, whatever their names;
    an empty table gives an empty one, and an empty benchmark rejects nothing.
    """
    bad = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece.

    Null and empty texts are one piece, the end alone; very long ones are cut; repeated rows and
    rows without doc_id are packed like any other; other columns are left out; an empty table
    gives no rows.
    """
    return pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fitted models and packing are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""A Parquet table that several writers change: each change is a new version, made from the one before or not at all.

Version n is the folder named in the small file ``log/n``.  A writer reads a version, writes
its result beside the others, and claims the next number by renaming its own file to that
name, which fails if somebody else has.  Then it must look again.  What was read stays as it
was, and a crash leaves at most a folder that no number names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Somebody else has made the next version."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    store = at("log").getFileSystem(conf)
    return jvm, at, store, jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf)


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version, -1 if there is none."""
    _, at, store, _ = _files(spark, path)
    if not store.exists(at("log")):
        return -1
    return max((int(f.getPath().getName()) for f in store.listStatus(at("log"))), default=-1)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last by default."""
    version = latest(spark, path) if version is None else version
    folder = spark.read.text(f"{path}/log/{version}").first()[0]
    return spark.read.parquet(f"{path}/{folder}")


def commit(df: DataFrame, path: str, base: int) -> int:
    """Makes df the version after base and returns its number; raises Conflict if there is one already."""
    spark = df.sparkSession
    jvm, at, store, context = _files(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    claim = at(f"{folder}.claim")
    out = store.create(claim, True)
    out.write(bytearray(folder.encode()))
    out.close()
    store.mkdirs(at("log"))
    none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    try:
        context.rename(claim, at(f"log/{base + 1}"), options)
    except Exception as e:
        if not store.exists(at(f"log/{base + 1}")):
            raise
        store.delete(claim, False)
        store.delete(at(folder), True)
        raise Conflict(f"version {base + 1} of {path} is there") from e
    return base + 1


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """Applies a change to the last version until nobody else has been quicker."""
    for _ in range(tries):
        base = latest(spark, path)
        try:
            return commit(change(read(spark, path, base)), path, base)
        except Conflict:
            continue
    raise Conflict(f"{path} changed {tries} times")

"""Queries that read what sinks have written, and of the page predicates and warp chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import captures, resolve
from leafmill.plans import fixtures as fx
from leafmill.plans.fixtures import oracle
from leafmill.sources import readers, sinks
from leafmill.sources.shared import scratch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_IMAGES = """select *, case when event_id % 3 > 0 then concat('color/', event_id, '.jpg') end as color, case when event_id % 4 > 0 then concat('llm/', event_id, '.jpg') end as llm_image,
 case when event_id % 5 > 0 then concat('pages/', event_id, '.md') end as md, case when event_id % 7 > 0 then concat('text ', event_id) end as text from {captures}"""
IMAGES = {"images": "select *, event_id % 3 > 0 as color, event_id % 4 > 0 as llm, event_id % 5 > 0 as md, case when event_id % 7 > 0 then 'text ' || event_id else '' end as text from captures"}


def images(spark, sf_dir):
    return spark.sql(_IMAGES, captures=fx.captures(spark, sf_dir))


@query(oracle("select event_id from images where color and status not in ('duplicate', 'deleted')", "captures", **IMAGES))
def facsimile_pages(spark, sf_dir):
    return captures.facsimile_pages(images(spark, sf_dir)).select("event_id")


@query(oracle("select event_id, text from images where (role is null or role <> 'cover') and status not in ('duplicate', 'deleted')", "captures", **IMAGES))
def assembled_pages(spark, sf_dir):
    return captures.assembled_pages(images(spark, sf_dir)).select("event_id", "text")


@query(oracle("select event_id from images where not md and llm and (role is null or role <> 'cover') and status <> 'deleted'", "captures", **IMAGES))
def unread_pages(spark, sf_dir):
    return captures.unread_pages(images(spark, sf_dir)).select("event_id")


_SCORES = "select user_id, event_id, value, event_type from {events}"


@query("select 'v' || user_id || '_f' || event_id as frame_id, value as sharpness, case when event_type = 'error' then 0.0 else 0.5 end as motion, 'v' || user_id as video from events")
def frame_scores(spark, sf_dir):
    """Score files, the records of several videos in each as written by Spark, read back and keyed by frame."""
    path = scratch(spark, "scores")
    rows = fx._run(spark, sf_dir, _SCORES, "events").selectExpr("concat('v', user_id) as video", "concat('f', event_id, '.jpg') as frame", "value as sharpness", "if(event_type = 'error', 0.0D, 0.5D) as motion")
    rows.repartition("video").write.json(path)
    back = spark.read.schema(readers.SCORE + ", video string").json(path)
    return readers.with_frame_ids(back).select("frame_id", "sharpness", "motion", "video")


@query("select doc_id, length(coalesce(text, '')) as chars, sha1(coalesce(text, '')) as digest from documents")
def snapshot_round_trip(spark, sf_dir):
    """A table replaced twice, the second time with everything."""
    path = scratch(spark, "table")
    docs = fx.load(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') as text")
    for part in (docs.where("doc_id % 2 = 0"), docs):
        sinks.snapshot(part, path)
    return spark.read.parquet(path).selectExpr("doc_id", "cast(length(text) as bigint) as chars", "sha1(cast(text as binary)) as digest")


@query(
    "select p_partkey as query, case when p_partkey % 3 > 0 then 'first ' || p_partkey when p_partkey % 2 = 0 then 'second ' || p_partkey else 'third ' || p_partkey end as title from part where p_partkey % 3 > 0 or p_partkey % 2 = 0 or p_partkey % 5 = 0"
)
def book_titles(spark, sf_dir):
    """Titles of the first source that has any: gaps are filled by the second, then the third."""
    parts = fx.load(spark, sf_dir, "part")
    source = lambda name, has: parts.selectExpr("p_partkey as query", f"if({has}, concat('{name} ', p_partkey), null) as title")
    return readers.first_filled(source("first", "p_partkey % 3 > 0"), source("second", "p_partkey % 2 = 0"), source("third", "p_partkey % 5 = 0"))


STEPS = "select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as pos, l_linenumber % 3 = 0 as clip, cast(l_quantity as double) as dx, cast(l_linenumber as double) as dy from {lineitem}"
_BACK = "sum(case when clip then 0 else {0} end) over (partition by page order by pos desc rows between unbounded preceding and current row)"


@query(
    oracle(
        "select o.page, cast(100 + coalesce(any_value(tx), 0) as double) as source_x, cast(200 + coalesce(any_value(ty), 0) as double) as source_y,"
        " cast(coalesce(min(least(100 + bx + 0.5, 400 + 10 * pos - 0.5 - (100 + bx), 200 + wy + 0.5, 300 - 0.5 - (200 + wy))) filter (clip), 1000000) as double) as margin"
        " from (select o_orderkey as page from orders) o left join (select *, sum(case when clip then 0 else dx end) over (partition by page) as tx, sum(case when clip then 0 else dy end) over (partition by page) as ty from back) b on b.page = o.page group by o.page",
        steps=STEPS.format(lineitem="lineitem"),
        back=f"select *, {_BACK.format('dx')} as bx, {_BACK.format('dy')} as wy from steps",
    )
)
def warped_points(spark, sf_dir):
    """A point of each order's page through the page's shifts, as its line items say, and every third item's clip."""
    rows = fx._run(spark, sf_dir, STEPS, "lineitem")
    steps = rows.selectExpr("page", "pos", "if(clip, 'clip', 'homography') as kind", "array(1D, 0D, -dx, 0D, 1D, -dy, 0D, 0D, 1D) as matrix", "if(clip, 400D + 10 * pos, null) as w", "if(clip, 300D, null) as h")
    points = fx.load(spark, sf_dir, "orders").selectExpr("o_orderkey as page", "100D as x", "200D as y")
    return resolve.source_points(points, steps).select("page", "source_x", "source_y", "margin")

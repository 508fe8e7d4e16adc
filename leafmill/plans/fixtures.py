"""Deterministic adapters from the driver tables to the engine's tables.

Each has a Spark form here and a DuckDB form, as common table expressions, in CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in tables}, **frames)


_FRAMES = """
select cast(user_id as bigint) as video, row_number() over (partition by user_id order by ts, event_id) as i,
       event_id, event_type, value as motion, case when event_type = 'error' then 0.01 else 0.6 end as flatness
from {events}"""

_PAGE_ORD = "row_number() over (partition by video % 5 order by video, i)"
_CAPTURES = f"""
select video % 5 as book_id, video, i as frame_no, event_id, event_type,
       concat('v', cast(video as string), '_f', cast(i as string)) as canonical,
       {_PAGE_ORD} as page_ord,
       case when event_type = 'error' then null
            when event_type = 'signup' and event_id % 7 = 0 then 2 * i - video % 2 + 60
            else 2 * i - video % 2 end as printed_number,
       event_type = 'purchase' and event_id % 11 = 0 as number_manual,
       case event_type when 'error' then 'low' when 'signup' then 'medium' else 'high' end as confidence,
       round(motion, 6) as composite,
       case when event_id % 53 = 0 then 'deleted' when event_id % 17 = 0 then 'suspect' else 'ok' end as status,
       case when event_id % 97 = 0 then concat('photo', cast(event_id as string)) end as patched_source,
       event_id % 41 = 0 as dedupe_exempt, event_id % 43 = 0 as manual_duplicate,
       case when event_id % 71 = 0 then 'start' when event_id % 73 = 0 then 'end' end as pinned,
       cast(case when event_id % 61 = 0 then 'cover' end as string) as role,
       case when event_id % 59 = 0 then 'pdf' end as source
from {{frames}}"""
#: Frames of a book's earlier videos, so that no task needs all frames of a book to place them.
_EARLIER = """
select video as v, sum(n) over (partition by video % 5 order by video rows between unbounded preceding and 1 preceding) as earlier
from (select video, count(*) as n from {frames} group by video)"""

_REVIEW = """
select book_id, page_ord, concat('p', cast(event_id as string)) as id, printed_number, status, confidence,
       case when event_id % 29 = 0 then 'timeout' end as transcribe_error,
       event_id % 31 = 0 as needs_reshoot, event_id % 37 = 0 as suspect_ignored,
       event_id % 19 = 0 as number_rejected, event_id % 23 = 0 as number_conflict,
       event_id % 13 = 0 as flag_blur, event_id % 11 = 0 as flag_multi_column, event_id % 47 = 0 as flag_cut_off_text,
       event_id % 67 = 0 as figure_quality, event_id % 5 = 0 as has_region, event_id % 10 = 0 as has_crop,
       event_id % 79 = 0 as stale_crop, event_id % 3 = 0 as has_image
from {captures}"""

#: Nine-line pages: an injected running header, headings, the document's lines, a page number.
_BOOK_LINES = """
select source as book_id, doc_id as page_ord, line_no, line from (
  select source, doc_id, pos as line_no, line from {exploded}
  union all select source, doc_id, -3 as line_no, 'The Long Road Home' as line from {documents} where doc_id % 3 = 0
  union all select source, doc_id, -2 as line_no,
         concat('# Part ', cast(doc_id % 40 as string)) as line from {documents} where doc_id % 10 = 0
  union all select source, doc_id, 1000000 as line_no, cast(doc_id as string) as line from {documents}) x"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _FRAMES, "events")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = frames(spark, sf_dir)
    placed = spark.sql("select * from {frames} left join {before} on video <=> v", frames=shown, before=spark.sql(_EARLIER, frames=shown))
    return spark.sql(_CAPTURES.replace(_PAGE_ORD, "cast(coalesce(earlier, 0) + i as int)"), frames=placed)


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REVIEW, captures=captures(spark, sf_dir))


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    exploded = docs.selectExpr("source", "doc_id", "posexplode(split(text, '\\n')) as (pos, line)")
    return spark.sql(_BOOK_LINES, exploded=exploded, documents=docs)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame quality records: cluster = order, sharpness = price, occlusion and motion = discount and tax."""
    sql = """select l_orderkey as cluster, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as frame,
                    l_extendedprice as sharpness, 0.3 + l_quantity / 100 as flatness,
                    l_discount + 0.0 as occlusion, l_tax + 0.0 as motion from {lineitem}"""
    return _run(spark, sf_dir, sql, "lineitem")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _JOBS, "orders")


_JOBS = """
select o_orderkey as id, o_custkey as project,
       case o_orderpriority when '1-URGENT' then 'pipeline' when '2-HIGH' then 'proof-chapter'
            when '3-MEDIUM' then 'tts' when '4-NOT SPECIFIED' then 'import' else 'build' end as kind,
       case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'running' end as status
from {orders}"""

_REGIONS = """
select l_orderkey as page, l_partkey as box, l_quantity / 100 as x0, l_discount + 0.0 as y0,
       l_quantity / 100 + 0.2 + l_tax as x1, l_discount + 0.25 as y1
from {lineitem}"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _REGIONS, "lineitem").distinct()


def cast_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, _CAST, "conversations")


_CAST = """
select conv_id as chapter, turn as ord, case when role = 'system' then 'NARRATOR' else role end as speaker, text as q
from {conversations}"""


def _plain(sql: str, **names: str) -> str:
    return sql.format(**names)


CTE = {
    "frames": _plain(_FRAMES, events="events"),
    "captures": _plain(_CAPTURES, frames="frames"),
    "review_pages": _plain(_REVIEW, captures="captures"),
    "exploded": "select source, doc_id, pos - 1 as pos, line from (select source, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, 1 + len(string_split(text, chr(10))))) as pos from documents) e",
    "book_lines": _plain(_BOOK_LINES, exploded="exploded", documents="documents"),
    "scores": """select l_orderkey as cluster, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as frame,
                    l_extendedprice as sharpness, 0.3 + l_quantity / 100 as flatness,
                    l_discount + 0.0 as occlusion, l_tax + 0.0 as motion from lineitem""",
    "jobs": _plain(_JOBS, orders="orders"),
    "regions": "select distinct * from (" + _plain(_REGIONS, lineitem="lineitem") + ") r",
    "cast_quotes": _plain(_CAST, conversations="conversations"),
}
NEEDS = {"captures": ["frames"], "review_pages": ["frames", "captures"], "book_lines": ["exploded"]}


def oracle(body: str, *adapters: str, **more: str) -> str:
    """DuckDB SQL: the adapters and more as common table expressions, then body."""
    names = list(dict.fromkeys(n for a in adapters for n in (*NEEDS.get(a, []), a)))
    parts = [f"{n} as ({CTE[n]})" for n in names] + [f"{n} as ({q})" for n, q in more.items()]
    return f"with {', '.join(parts)} {body}" if parts else body

"""Queries of page mutations, over pages made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import mutations, review
from leafmill.plans import fixtures as fx
from leafmill.plans.fixtures import oracle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


REGION = "struct<type:string,bbox_norm:array<double>,caption:string,deleted:boolean,own_image:boolean,user_crop:boolean>"
_PAGES = """
select concat('p', event_id) as id, concat('v', user_id, '_f', event_id) as canonical, case when event_id % 31 = 0 then concat('photo', event_id) end as patched_source,
 case when event_id % 3 = 0 then 'L' end as side, case when event_id % 17 = 0 then 'suspect' else 'ok' end as status, concat('pages/p', event_id, '.md') as md,
 case when event_type = 'error' then 'low' else 'high' end as confidence, case when event_id % 7 = 0 then array('blur') end as flags, case when event_id % 29 = 0 then 'timeout' end as transcribe_error,
 case when event_id % 13 > 0 then event_id % 500 end as printed_number, event_id % 19 = 0 as number_manual, event_id % 23 = 0 as needs_reshoot, event_id % 5 as n_regions, event_id % 4 as own_at
from {events}"""


def pages(spark, sf_dir):
    """Pages with up to four regions, of which one may be a close-up of its own."""
    rows = fx._run(spark, sf_dir, _PAGES, "events")
    region = "struct('figure' as type, array(0.1D, 0.2D, 0.3D, 0.4D) as bbox_norm, concat('c', i) as caption, false as deleted, i = own_at as own_image, i = 2 as user_crop)"
    rows = rows.withColumn("regions", F.expr(f"if(n_regions = 0, null, transform(sequence(0, n_regions - 1), i -> {region}))").cast(f"array<{REGION}>"))
    return rows.withColumn("figures", F.expr("if(n_regions = 0, null, transform(sequence(0, n_regions - 1), i -> concat('figures/', id, '_', char(97 + i), '.png')))"))


def photos(spark, sf_dir):
    """A reshoot of some pages, a patch of others, both of a few."""
    sql = """select concat('p', event_id) as id, s as seq, case when (event_id % 10 = 0) = (s = 1) then 'reshoot' else 'patch' end as kind, concat('new', event_id, '_', s) as source,
             case when event_id % 20 = 0 then event_id % 700 end as number from {events} lateral view explode(array(1, 2)) x as s where (s = 1 and event_id % 10 in (0, 1)) or (s = 2 and event_id % 50 = 1)"""
    return fx._run(spark, sf_dir, sql, "events")


EVENT = "select *, event_id % 5 as n, event_id % 4 as own from events"
PHOTO = "select *, case when event_id % 10 = 0 then 'reshoot' else 'patch' end as change from e where event_id % 10 in (0, 1)"
KEEPS = "change = 'reshoot' and own < n"
LOST = f"""select 'p' || event_id as id, field, change as reason, case field when 'md' then 'image' when 'figures' then 'regions' else 'md' end as via from ph, (values ('md'), ('confidence'), ('flags'), ('transcribe_error'), ('regions'), ('figures')) f(field)
 where field in ('md', 'confidence') or (field = 'flags' and event_id % 7 = 0) or (field = 'transcribe_error' and event_id % 29 = 0) or (field in ('regions', 'figures') and n > 0 and not ({KEEPS}))"""
TURNED = "select *, 'rotation' as change from e where user_id % 6 = 0"
SPUN = """select 'p' || event_id as id, field, change as reason, case field when 'md' then 'image' else 'md' end as via from tu, (values ('md'), ('confidence'), ('flags'), ('transcribe_error'), ('printed_number')) f(field)
 where field in ('md', 'confidence') or (field = 'flags' and event_id % 7 = 0) or (field = 'transcribe_error' and event_id % 29 = 0) or (field = 'printed_number' and event_id % 13 > 0)"""


def rotations(spark, sf_dir):
    videos = fx.load(spark, sf_dir, "events").selectExpr("concat('v', user_id) as video", "if(user_id % 3 = 0, 180, 0) as rotate").distinct()
    asked = videos.where("rotate = 180").selectExpr("video", "1 as seq", "if(cast(substring(video, 2) as bigint) % 6 = 0, 0, 180) as rotate")
    return mutations.turned(videos, asked)


@query(oracle(f"from lost union all from spun", e=EVENT, ph=PHOTO, tu=TURNED, lost=LOST, spun=SPUN))
def cleared_fields(spark, sf_dir):
    """A row for each field that a photo or a rotation cleared, with the reason and the field it followed from."""
    rows = pages(spark, sf_dir)
    taken = mutations.take_photos(rows, photos(spark, sf_dir)).select("id", "cleared")
    spun = mutations.rotate_videos(rows, rotations(spark, sf_dir)).select("id", "cleared")
    return taken.unionByName(spun).select("id", F.inline("cleared"))


@query(
    oracle(
        f"""select 'p' || event_id as id, case when change is null then case when event_id % 17 = 0 then 'suspect' else 'ok' end else 'patched' end as status,
 case when change is null then case when event_id % 31 = 0 then 'photo' || event_id end else 'new' || event_id || '_' || case when event_id % 50 = 1 then 2 else 1 end end as patched_source,
 case when (change = 'reshoot' or event_id % 50 = 1) and event_id % 20 = 0 then event_id % 700 when event_id % 13 > 0 then event_id % 500 end as printed_number,
 event_id % 19 = 0 or (change = 'reshoot' and event_id % 20 = 0) as number_manual, case when change = 'reshoot' or event_id % 50 = 1 then false else event_id % 23 = 0 end as needs_reshoot,
 cast(case when change is null then n when {KEEPS} then own + 1 else 0 end as int) as n_regions, case when change is null then n when {KEEPS} then 1 else 0 end = 0 or change is null as plain,
 case when change is not null and {KEEPS} then 'figures/p' || event_id || '_' || chr(cast(97 + own as int)) || '.png' end as kept
 from (select e.*, ph.change from e left join ph using (event_id))""",
        e=EVENT,
        ph=PHOTO,
    )
)
def photo_changes(spark, sf_dir):
    out = mutations.take_photos(pages(spark, sf_dir), photos(spark, sf_dir))
    changed = F.col("status") == "patched"
    own = F.size(F.filter(F.coalesce("regions", F.array().cast(f"array<{REGION}>")), lambda r: ~r["deleted"])) == 1
    return out.select(
        "id", "status", "patched_source", "printed_number", "number_manual", "needs_reshoot", F.coalesce(F.size("regions"), F.lit(0)).alias("n_regions"),
        (~(changed & own)).alias("plain"), F.when(changed, F.get("figures", 0)).alias("kept"),
    )


@query(oracle("select 'v' || user_id || '_f' || event_id as key from e where user_id % 6 <> 0", e=EVENT))
def rotated_cache(spark, sf_dir):
    cache = pages(spark, sf_dir).selectExpr("canonical as key", "printed_number")
    return mutations.rotate_cache(cache, rotations(spark, sf_dir)).select("key")


@query("select 'p' || event_id as id, case when event_id % 19 = 0 or event_id % 2 = 1 then case when event_id % 13 > 0 then event_id % 500 end else 7000 + event_id end as printed_number, event_id % 37 = 0 and (event_id % 19 = 0 or event_id % 2 = 1) as number_rejected from events")
def pristine_numbers(spark, sf_dir):
    rows = pages(spark, sf_dir).withColumn("number_rejected", F.expr("cast(substring(id, 2) as bigint) % 37 = 0"))
    read = rows.where("cast(substring(id, 2) as bigint) % 2 = 0").select(mutations.side_key().alias("key"), F.expr("7000 + cast(substring(id, 2) as bigint)").alias("printed_number"))
    return mutations.pristine_numbers(rows, read).select("id", "printed_number", "number_rejected")


@query(
    oracle(
        "select id, suspect_ignored or event_id % 3 = 0 as suspect_ignored, case when event_id % 4 = 0 and status = 'suspect' then 'ok' else status end as status, case when event_id % 4 = 0 and event_id % 8 > 0 then 'Part ' || event_id when event_id % 4 > 0 then 'old' end as section,"
        " event_id % 3 = 0 as waived from (select *, cast(id[2:] as bigint) as event_id from review_pages)",
        "review_pages",
    )
)
def vouched_pages(spark, sf_dir):
    flags = "array_compact(array(if(flag_blur, 'blur', null), if(flag_multi_column, 'multi_column', null), if(flag_cut_off_text, 'cut_off_text', null))) as flags"
    rows = fx.review_pages(spark, sf_dir).selectExpr("*", flags, "'old' as section", "cast(null as array<string>) as ignored_reasons")
    n = "cast(substring(id, 2) as bigint)"
    edits = rows.where(f"{n} % 3 = 0 or {n} % 4 = 0").selectExpr("id", f"{n} % 3 = 0 as ignore_suspect", f"{n} % 4 = 0 as section_set", f"if({n} % 8 > 0, concat(' Part ', {n}, ' '), ' ') as section")
    out = mutations.vouch(rows, edits, review.reasons())
    return out.select("id", "suspect_ignored", "status", "section", F.col("ignored_reasons").isNotNull().alias("waived"))


#: Documents with the pictures a to c among their words; pictures of some are deleted, renamed or swapped.
def _figured(spark, sf_dir):
    link = lambda k: f"concat('![old {k}](figures/p', doc_id, '_{k}.png)')"
    text = f"concat({link('a')}, '\\n', coalesce(text, ''), {link('b')}, ' ', {link('c')})"
    rows = fx.load(spark, sf_dir, "documents").selectExpr("concat('p', doc_id) as id", "doc_id", f"{text} as md_text", "transform(array('a', 'b', 'c'), k -> concat('figures/p', doc_id, '_', k, '.png')) as figures")
    region = "named_struct('caption', concat('old ', k), 'caption_manual', false, 'deleted', false)"
    return rows.withColumn("regions", F.expr(f"transform(array('a', 'b', 'c'), k -> {region})"))


def _link(caption: str, k: str) -> str:
    return f"('![' || {caption} || '](figures/p' || doc_id || '_{k}.png)')"


@query(
    f"select 'p' || doc_id as id, sha1(case when doc_id % 2 = 0 then coalesce(text, '') else {_link(chr(39) + 'old a' + chr(39), 'a')} || chr(10) || coalesce(text, '') end || {_link(chr(39) + 'old b' + chr(39), 'b')} || ' ' || case when doc_id % 6 = 0 then '' else {_link(chr(39) + 'old c' + chr(39), 'c')} end) as digest,"
    " case when doc_id % 2 = 0 then 'x' else '-' end || '-' || case when doc_id % 6 = 0 then 'x' else '-' end as gone, cast(3 - (doc_id % 2 = 0)::int - (doc_id % 6 = 0)::int as int) as n_figures from documents"
)
def deleted_figures(spark, sf_dir):
    rows = _figured(spark, sf_dir)
    gone = rows.where("doc_id % 2 = 0").selectExpr("id", "explode(if(doc_id % 6 = 0, array(figures[0], figures[2], figures[2]), array(figures[0]))) as rel")
    out = mutations.delete_figures(rows, gone)
    return out.select("id", F.sha1(F.col("md_text").cast("binary")).alias("digest"), F.array_join(F.transform("regions", lambda r: F.when(r["deleted"], "x").otherwise("-")), "").alias("gone"), F.size("figures").alias("n_figures"))


CAPTION = "case when doc_id % 3 = 0 then 'new $1 \\ ' || doc_id else '{0}' end"


@query(
    f"select 'p' || doc_id as id, sha1({_link('a', 'a')} || chr(10) || coalesce(text, '') || {_link('b', 'b')} || ' ' || {_link('c', 'c')}) as digest, a || '|' || b || '|' || c as captions from"
    f" (select *, case when doc_id % 5 = 0 then c0 else a0 end as a, 'old b' as b, case when doc_id % 5 = 0 then a0 else c0 end as c from (select *, {CAPTION.format('old a')} as a0, 'old c' as c0 from documents))"
)
def captions(spark, sf_dir):
    rows = _figured(spark, sf_dir)
    asked = rows.where("doc_id % 3 = 0").selectExpr("id", "explode(array(1, 2)) as seq", "figures[0] as rel", "doc_id").selectExpr("id", "seq", "rel", r"if(seq = 1, 'lost', concat(' new $1 \\ ', doc_id, ' ')) as caption")
    named = mutations.set_captions(rows, asked)
    swapped = named.where("doc_id % 5 = 0")
    out = named.where("doc_id % 5 <> 0").unionByName(mutations.swap_captions(swapped, swapped.selectExpr("id", "figures[0] as a", "figures[2] as b")))
    return out.select("id", F.sha1(F.col("md_text").cast("binary")).alias("digest"), F.array_join("regions.caption", "|").alias("captions"))


@query("select 'v' || user_id || '_f' || event_id as frame, case when user_id % 3 = 0 and user_id % 2 = 0 then 180 else 0 end as rotate from events")
def frame_rotations(spark, sf_dir):
    events = fx.load(spark, sf_dir, "events")
    videos = events.where("user_id % 2 = 0").selectExpr("concat('v', user_id) as video", "if(user_id % 3 = 0, 180, 0) as rotate").distinct()
    return mutations.rotation_of(events.selectExpr("concat('v', user_id, '_f', event_id) as frame"), videos)

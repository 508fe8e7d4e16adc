"""Queries over frames, captures and reviews, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import resolve, review, sequence
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


BODY = "role is null and pinned is null and status not in ('duplicate', 'deleted')"
MASK = """select f.*, n <= 1 or ((i = 1 or motion < greatest(mid, 1e-3)) and flatness > 0.05) as at_rest
from frames f join (select video, median(motion) filter (i > 1) as mid, count(*) as n from frames group by 1) s using (video)"""
SEG = {
    "mask": MASK,
    "rest": "select *, sum(g) over (partition by video order by i) as page from (select *, case when i - lag(i) over (partition by video order by i) - 1 >= 2 then 1 else 0 end as g from mask where at_rest)",
    "pages": """select * from (select video, cast(page as bigint) as page, min(i) as first_i, max(i) as last_i, count(*) as n_frames, avg(motion) as mean_motion from rest group by all)
join (select video, coalesce(median(motion) filter (motion > 0), 0.0) as floor from rest group by 1) using (video)""",
}
RATED = {
    "norms": "select coalesce(quantile_cont(sharpness, 0.95), 0.0) as sharp_hi, coalesce(median(motion) filter (motion > 0), 1.0) as motion_med from scores",
    "rated": """select s.*, greatest(least(sharpness / sharp_hi, 1.0), 1e-6) * greatest(flatness, 1e-6) * greatest(1.0 - least(occlusion * 4.0, 1.0), 1e-6)
 * greatest(1.0 / (1.0 + motion / motion_med), 1e-6) as composite from scores s, norms""",
    "ranked": "select *, row_number() over (partition by cluster order by round(composite, 12) desc, frame) as r from rated",
    "best": "select cluster, max(frame) filter (r = 1) as canonical, max(frame) filter (r = 2) as fallback, round(max(composite) filter (r = 1), 6) as composite from ranked where r <= 2 group by 1",
}


@query(oracle("select video, i, at_rest from mask", "frames", mask=MASK))
def rest_mask(spark, sf_dir):
    return sequence.rest_mask(fx.frames(spark, sf_dir)).select("video", "i", "at_rest")


@query(oracle("select video, page, first_i, last_i, n_frames, round(mean_motion, 6) as mean_motion from pages where n_frames >= 2 and (n_frames >= 4 or mean_motion <= 2.0 * floor)", "frames", **SEG))
def segment_pages(spark, sf_dir):
    return sequence.segment_pages(fx.frames(spark, sf_dir)).withColumn("mean_motion", F.round("mean_motion", 6))


@query(oracle("select round(sharp_hi, 6) as sharp_hi, round(motion_med, 6) as motion_med from norms", "scores", norms=RATED["norms"]))
def score_norms(spark, sf_dir):
    return sequence.score_norms(fx.scores(spark, sf_dir)).select(F.round("sharp_hi", 6).alias("sharp_hi"), F.round("motion_med", 6).alias("motion_med"))


@query(oracle("select * from best", "scores", **RATED))
def best_frame_top2(spark, sf_dir):
    return sequence.best_frames(fx.scores(spark, sf_dir)).withColumn("composite", F.round("composite", 6))


@query(oracle("select cluster, canonical, composite from best where composite < 0.5 * (select quantile_cont(composite, 0.1) from best)", "scores", **RATED))
def low_tail_suspects(spark, sf_dir):
    best = sequence.best_frames(fx.scores(spark, sf_dir)).withColumn("composite", F.round("composite", 6))
    return sequence.low_tail(best).select("cluster", "canonical", "composite")


@query(oracle(f"select book_id, page_ord, canonical from captures where {BODY}", "captures"))
def body_pages(spark, sf_dir):
    return fx.captures(spark, sf_dir).where(sequence.is_body()).select("book_id", "page_ord", "canonical")


@query(oracle("select canonical, cast(split_part(canonical, '_f', 2) as int) as frame_no from captures", "captures"))
def capture_order_key(spark, sf_dir):
    """Frame number after the last ``_f``; what isn't a number gives null."""
    return fx.captures(spark, sf_dir).select("canonical", F.expr("try_cast(regexp_extract(canonical, '_f([0-9]+)$', 1) as int)").alias("frame_no"))


NEIGHBOURS = """select *, last_value(case when printed_number is not null then pos end ignore nulls) over (partition by {keys} order by {by} rows between unbounded preceding and 1 preceding) as at_a,
 last_value(printed_number ignore nulls) over (partition by {keys} order by {by} rows between unbounded preceding and 1 preceding) as n_a,
 first_value(case when printed_number is not null then pos end ignore nulls) over (partition by {keys} order by {by} rows between 1 following and unbounded following) as at_b,
 first_value(printed_number ignore nulls) over (partition by {keys} order by {by} rows between 1 following and unbounded following) as n_b
 from (select *, row_number() over (partition by {keys} order by {by}) as pos from {rows} where """ + BODY + ")"  # noqa: E501
VIDEO = {
    "near": NEIGHBOURS.format(keys="video", by="frame_no", rows="captures"),
    "filled": "select book_id, page_ord, n_a + (pos - at_a) * ((n_b - n_a) // (at_b - at_a)) as value from near where printed_number is null and n_b <> n_a and (n_b - n_a) % (at_b - at_a) = 0 and abs((n_b - n_a) // (at_b - at_a)) between 1 and 2",
    "inferred": "select c.* exclude (printed_number), coalesce(printed_number, value) as printed_number, value is not null as number_inferred from captures c left join filled using (book_id, page_ord)",
}
PARITY = "select video, case when count(*) < 5 then null when avg(printed_number % 2) > 0.8 then 1 when avg(printed_number % 2) < 0.2 then 0 end as parity from {rows} where {body} and printed_number >= 1 and not number_inferred group by 1"


@query(oracle("select book_id, page_ord, printed_number, number_inferred from inferred", "captures", **VIDEO))
def infer_video_order(spark, sf_dir):
    return sequence.infer_from_video_order(fx.captures(spark, sf_dir)).select("book_id", "page_ord", "printed_number", "number_inferred")


@query(oracle("select * from parity", "captures", parity=PARITY.format(rows="(select *, false as number_inferred from captures)", body=BODY)))
def video_parity(spark, sf_dir):
    return sequence.video_parity(fx.captures(spark, sf_dir).withColumn("number_inferred", F.lit(False)))


MISSING = VIDEO | {
    "parity": PARITY.format(rows="inferred", body=BODY),
    "around": NEIGHBOURS.format(keys="book_id", by="page_ord", rows="inferred"),
    "fit": """select book_id, page_ord, status, n_a + (pos - at_a) * ((n_b - n_a) // (at_b - at_a)) as value, parity, n_b - n_a as span, at_b - at_a as slots,
 (n_b - n_a) > 0 and (n_b - n_a) % (at_b - at_a) = 0 and (n_b - n_a) // (at_b - at_a) between 1 and 2 as fits
 from around left join parity using (video) where printed_number is null""",
}


@query(
    oracle(
        """select i.book_id, i.page_ord, case when printed_number is null and fits and (parity is null or value % 2 = parity) then value else printed_number end as printed_number,
 coalesce(not fits and span > 0 and span <= slots - 1, false) as number_conflict, case when not fits and span > 0 and span <= slots - 1 and i.status = 'ok' then 'suspect' else i.status end as status
 from inferred i left join fit f using (book_id, page_ord)""",
        "captures",
        **MISSING,
    )
)
def infer_missing(spark, sf_dir):
    rows = sequence.infer_missing(sequence.infer_from_video_order(fx.captures(spark, sf_dir)))
    return rows.select("book_id", "page_ord", "printed_number", "number_conflict", "status")


HAVE = f"select distinct book_id, printed_number as n from captures where {BODY} and printed_number >= 1"
LACK = "select book_id, n from (select book_id, unnest(range(lo, hi + 1)) as n from (select book_id, min(n) as lo, max(n) as hi from have group by 1)) e where not exists (select 1 from have h where h.book_id = e.book_id and h.n = e.n)"


@query(oracle("select * from lack", "captures", have=HAVE, lack=LACK))
def missing_pages(spark, sf_dir):
    return sequence.missing_numbers(fx.captures(spark, sf_dir))


@query(
    oracle(
        "select book_id, string_agg(case when lo = hi then cast(lo as varchar) else lo || '-' || hi end, ', ' order by lo) as ranges from (select book_id, min(n) as lo, max(n) as hi from (select *, n - row_number() over (partition by book_id order by n) as g from have) group by book_id, g) group by 1",
        "captures",
        have=HAVE,
    )
)
def format_ranges(spark, sf_dir):
    rows = fx.captures(spark, sf_dir).where(sequence.is_body() & (F.col("printed_number") >= 1))
    return sequence.format_ranges(rows.select("book_id", F.col("printed_number").alias("n")))


@query(
    oracle(
        "select book_id, page_ord as before_ord, last + 1 as first_missing, printed_number - 1 as last_missing from (select *, lag(printed_number) over (partition by book_id order by page_ord) as last from captures where printed_number >= 1) where printed_number > last + 1",
        "captures",
    )
)
def gap_markers(spark, sf_dir):
    return sequence.gap_markers(fx.captures(spark, sf_dir))


REORDER = {
    "grouped": "select *, case when pinned = 'end' then 2 when pinned = 'start' or role = 'cover' then 0 else 1 end as part from captures",
    "placed": """select *, row_number() over (partition by book_id, part order by page_ord) - 1 as pos, count(*) over (partition by book_id, part) as many,
 last_value(printed_number ignore nulls) over (partition by book_id, part, video order by frame_no rows between unbounded preceding and 1 preceding) as pa,
 first_value(printed_number ignore nulls) over (partition by book_id, part, video order by frame_no rows between 1 following and unbounded following) as pb from grouped""",
    "based": "select *, coalesce(cast(printed_number as double), case when pa is not null and pb is not null then (pa + pb) / 2.0 when pa is not null then pa + 0.5 else pb - 0.5 end + cast(pos as double) * cast(1e-6 as double)) as base from placed",
    "keyed": """select *, case when part <> 1 then cast(pos as double) else coalesce(last_value(base ignore nulls) over w + cast(0.001 as double) * (pos - last_value(case when base is not null then pos end ignore nulls) over w),
 first_value(printed_number ignore nulls) over (partition by book_id, part order by page_ord rows between unbounded preceding and unbounded following) - cast(0.001 as double) * (many - pos)) end as key
 from based window w as (partition by book_id, part order by page_ord rows between unbounded preceding and current row)""",
}


@query(oracle("select book_id, page_ord, round(key, 6) as key, row_number() over (partition by book_id order by part, key, page_ord) as new_ord from keyed", "captures", **REORDER))
def reorder_pages(spark, sf_dir):
    rows = sequence.reorder(fx.captures(spark, sf_dir))
    return rows.select("book_id", "page_ord", F.round("key", 6).alias("key"), "new_ord")


@query(
    oracle(
        "select * from (select book_id, page_ord, printed_number, lag(page_ord) over w as prev_ord, lag(printed_number) over w as prev_number from captures where printed_number is not null and status not in ('duplicate', 'deleted') window w as (partition by book_id order by page_ord)) where printed_number <= prev_number",
        "captures",
    )
)
def monotonic_check(spark, sf_dir):
    return sequence.monotonic_violations(fx.captures(spark, sf_dir))


TAKES = "printed_number is not null and role is null and status <> 'deleted' and coalesce(source not in ('pdf', 'epub'), true) and not dedupe_exempt and not manual_duplicate"


@query(
    oracle(
        f"select book_id, page_ord, case when takes and r > 1 then 'duplicate' else status end as status from (select *, row_number() over (partition by book_id, takes, printed_number order by patched_source is not null desc, case confidence when 'high' then 2 when 'medium' then 1 else 0 end desc, composite desc, page_ord) as r from (select *, {TAKES} as takes from captures))",
        "captures",
    )
)
def dedupe_printed(spark, sf_dir):
    return sequence.dedupe_by_number(fx.captures(spark, sf_dir)).select("book_id", "page_ord", "status")


@query()
def sanitize_numbers(spark, sf_dir):
    return sequence.sanitize_numbers(fx.captures(spark, sf_dir)).select("book_id", "page_ord", "printed_number", "number_rejected")


@query()
def reconcile(spark, sf_dir):
    return sequence.reconcile(fx.captures(spark, sf_dir)).select("book_id", "page_ord", "new_ord", "canonical", "printed_number", "status")


def _flagged(spark, sf_dir):
    names = ("blur", "cut_off_text", "multi_column")
    flags = F.filter(F.array(*(F.when(F.col(f"flag_{n}"), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return fx.review_pages(spark, sf_dir).withColumn("flags", flags)


@query(
    oracle(
        "select book_id, page_ord from review_pages where transcribe_error is not null or confidence = 'low' or flag_blur or flag_multi_column or flag_cut_off_text",
        "review_pages",
    )
)
def escalation_set(spark, sf_dir):
    return _flagged(spark, sf_dir).where(review.needs_escalation()).select("book_id", "page_ord")


@query(oracle("select book_id, page_ord from review_pages where (confidence = 'low' or flag_blur or flag_cut_off_text) and not suspect_ignored", "review_pages"))
def suspects_after_reading(spark, sf_dir):
    return _flagged(spark, sf_dir).where(review.suspect_after_reading()).select("book_id", "page_ord")


@query(oracle("select book_id, page_ord, id from review_pages where status <> 'deleted' and transcribe_error is not null and has_image", "review_pages"))
def failed_retry_set(spark, sf_dir):
    return fx.review_pages(spark, sf_dir).where("status <> 'deleted' and transcribe_error is not null and has_image").select("book_id", "page_ord", "id")


RULES = [
    ("transcribe_error is not null", "read_failed"), ("not suspect_ignored and confidence = 'low'", "low_confidence"),
    ("not suspect_ignored and flag_blur", "flag:blur"), ("not suspect_ignored and flag_cut_off_text", "flag:cut_off_text"),
    ("not suspect_ignored and flag_multi_column", "note:multi_column"), ("not suspect_ignored and figure_quality", "figure_quality"),
    ("needs_reshoot", "marked"), ("has_region and stale_crop", "stale_crop"), ("number_rejected", "number_rejected"),
    ("number_conflict", "number_conflict"), ("has_region and not has_crop", "no_crop"),
]
LISTED = "select *, list_filter([" + ", ".join(f"case when {c} then '{n}' end" for c, n in RULES) + "], lambda x: x is not null) as found from review_pages"
REASONED = "select * exclude (found), case when len(found) = 0 and status = 'suspect' and not suspect_ignored then ['poor_capture'] else found end as found from listed"


@query(oracle("select book_id, page_ord, array_to_string(found, ',') as reasons from reasoned", "review_pages", listed=LISTED, reasoned=REASONED))
def page_reasons(spark, sf_dir):
    return _flagged(spark, sf_dir).select("book_id", "page_ord", F.array_join(review.reasons(), ",").alias("reasons"))


WORK = "transcribe_error is not null or needs_reshoot or number_rejected or number_conflict or (has_region and stale_crop)"


@query(
    oracle(
        f"""select book_id, page_ord, queue, case when queue = 'reshoot' then array_to_string(real, ',') else '' end as reasons from (
 select *, case when transcribe_error is not null then 'reread' when has_region and not has_crop and not ({WORK}) then 'crop' when len(real) > 0 then 'reshoot' end as queue from (
 select *, list_filter(found, lambda x: not starts_with(x, 'note:') and x <> 'no_crop') as real from reasoned where status not in ('duplicate', 'deleted'))) where queue is not null""",
        "review_pages",
        listed=LISTED,
        reasoned=REASONED,
    )
)
def work_queues(spark, sf_dir):
    return review.work_queues(_flagged(spark, sf_dir))


CAPTURE = "coalesce(patched_source, canonical)"


@query(
    oracle(
        f"select c.book_id, c.page_ord, k.text, k.text is not null as cached from captures c left join (select 'v' || cast(user_id as varchar) || '_f' || cast(row_number() over (partition by user_id order by ts, event_id) as varchar) as capture, event_type as text, event_id from events) k on {CAPTURE} = k.capture and k.event_id % 2 = 0",
        "captures",
    )
)
def cache_restore(spark, sf_dir):
    cache = fx.captures(spark, sf_dir).where("event_id % 2 = 0").select(F.col("canonical").alias("capture"), F.col("event_type").alias("text"))
    return resolve.restore_cached(fx.captures(spark, sf_dir), cache).select("book_id", "page_ord", "text", "cached")


@query(oracle(f"select book_id, page_ord, canonical from captures where {CAPTURE} in (select canonical from captures where status = 'deleted')", "captures"))
def deleted_captures(spark, sf_dir):
    rows = fx.captures(spark, sf_dir)
    gone = rows.where("status = 'deleted'").select(F.col("canonical").alias("capture"))
    return rows.withColumn("capture", resolve.capture_key()).join(gone, "capture", "left_semi").select("book_id", "page_ord", "canonical")


@query(
    oracle(
        "select id, min(match) as match from (select e.id, n.match from (select user_id as id, unnest([event_id, event_id + 1, event_id + 2]) as f from events where event_id % 13 = 0) e left join (select event_id as match, unnest([event_id, event_id - 1]) as f from events where event_id % 7 = 0) n using (f)) group by 1",
    )
)
def patched_overlap(spark, sf_dir):
    events = fx.load(spark, sf_dir, "events")
    old = events.where("event_id % 13 = 0").groupBy(F.col("user_id").alias("id")).agg(F.flatten(F.collect_list(F.expr("array(event_id, event_id + 1, event_id + 2)"))).alias("frames"))
    new = events.where("event_id % 7 = 0").select(F.col("event_id").alias("id"), F.expr("array(event_id, event_id - 1)").alias("frames"))
    return resolve.first_overlap(old, new)


@query(oracle("select f.video, f.i from frames f where not exists (select 1 from pages p where p.video = f.video and f.i between p.first_i and p.last_i)", "frames", **(SEG | {"pages": "select * from (" + SEG["pages"] + ") where n_frames >= 2 and (n_frames >= 4 or mean_motion <= 2.0 * floor)"})))
def unreferenced_frames(spark, sf_dir):
    frames = fx.frames(spark, sf_dir)
    used = sequence.segment_pages(frames).select("video", F.explode(F.sequence("first_i", "last_i")).alias("i"))
    return frames.join(used, ["video", "i"], "left_anti").select("video", "i")


@query(oracle("select book_id, video, frame_no, row_number() over (partition by book_id order by video, case when video % 3 = 0 then -frame_no else frame_no end) as new_ord from captures", "captures"))
def capture_sequence(spark, sf_dir):
    rows = fx.captures(spark, sf_dir)
    videos = rows.select("video").distinct().withColumn("direction", F.when(F.col("video") % 3 == 0, "reverse").otherwise("forward"))
    return resolve.capture_sequence(rows, videos).select("book_id", "video", "frame_no", "new_ord")


SPREAD = "case when event_id % 9 = 0 then case when video % 3 = 0 then ['right', 'left'] else ['left', 'right'] end else [null] end"


@query(
    oracle(
        f"select book_id, case when side = 'right' then id || 'r' else id end as id, side, cast(k - 1 as int) as spread_order from (select book_id, 'p' || cast(event_id as varchar) as id, unnest({SPREAD}) as side, unnest(range(1, 1 + len({SPREAD}))) as k from captures)",
        "captures",
    )
)
def split_spreads(spark, sf_dir):
    rows = fx.captures(spark, sf_dir).selectExpr("book_id", "concat('p', cast(event_id as string)) as id", "event_id % 9 = 0 as spread", "video % 3 = 0 as reverse")
    return resolve.split_spreads(rows).select("book_id", "id", "side", "spread_order")


HASH = """select label, vec_id as id, lower(string_agg(printf('%x', d), '' order by k)) as hash from (select label, vec_id, k, cast(list_sum(list_transform(range(1, 5), lambda j: case when embedding[4 * k + j] > mid then 1 << (4 - j) else 0 end)) as bigint) as d
 from (select *, list_sort(embedding[2:])[32] as mid from embeddings), (select unnest(range(0, 16)) as k)) group by all"""


def _hashes(spark, sf_dir):
    return fx.load(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), resolve.sign_hash("embedding").alias("hash"))


@query(oracle("select label, string_agg(printf('%x', cast(v as bigint)), '' order by d) as hash from (select label, d, sum(case when 2 * c > n then b else 0 end) as v from (select label, d, b, sum(case when (('0x' || hash[d])::bigint & b) > 0 then 1 else 0 end) as c, count(*) as n from hashes, (select unnest(range(1, 17)) as d), (select unnest([8, 4, 2, 1]) as b) group by all) group by all) group by 1", hashes=HASH))
def majority_hash(spark, sf_dir):
    return resolve.majority_hash(_hashes(spark, sf_dir))


@query(oracle("select * from (select a.label, a.id as id_a, b.id as id_b, cast(bit_count(xor(('0x' || a.hash[1:8])::bigint, ('0x' || b.hash[1:8])::bigint)) + bit_count(xor(('0x' || a.hash[9:16])::bigint, ('0x' || b.hash[9:16])::bigint)) as int) as distance from hashes a join hashes b on a.label = b.label and a.id < b.id) where distance <= 20", hashes=HASH))
def hamming_pairs(spark, sf_dir):
    return resolve.hamming_pairs(_hashes(spark, sf_dir))


IOU = {
    "pairs": """select a.page, a.box as box_a, b.box as box_b, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as inter,
 (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as areas from regions a join regions b on a.page = b.page and a.box < b.box""",
}


@query(oracle("select page, box_a, box_b, round(inter / (areas - inter), 6) as iou from pairs where areas - inter > 0 and inter / (areas - inter) > 0.05", "regions", **IOU))
def iou_pairs(spark, sf_dir):
    return resolve.box_pairs(fx.regions(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@query(
    """with s as (select item_id as snippet_id, substring(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 160) as target from benchmark),
 p as (select doc_id as page_ord, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as body from documents)
 select snippet_id, min(page_ord) as page_ord from s join p on contains(body, target) where length(target) >= 12 group by 1"""
)
def passage_to_page(spark, sf_dir):
    snippets = fx.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("snippet_id"), "text")
    return resolve.first_containing(snippets, fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_ord"), "text"))

"""Queries over the rest of the page life cycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import captures, resolve, review, sequence
from leafmill.plans import fixtures as fx
from leafmill.plans.core import HAVE, LACK, LISTED, REASONED, WORK
from leafmill.plans.core import HASH
from leafmill.plans.fixtures import oracle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(oracle("select book_id, count(*) filter (status not in ('duplicate', 'deleted')) as pages, count(*) filter (status = 'suspect') as suspects, count(*) filter (status = 'duplicate') as duplicates from captures group by 1", "captures"))
def project_summary(spark, sf_dir):
    return captures.project_summary(fx.captures(spark, sf_dir))


@query(oracle("select book_id, page_ord, coalesce(case when event_id % 100 = 0 then event_id end, printed_number) as printed_number, event_id % 100 = 0 or number_manual as number_manual from captures", "captures"))
def manual_numbers(spark, sf_dir):
    rows = fx.captures(spark, sf_dir)
    edits = rows.where("event_id % 100 = 0").selectExpr("book_id", "page_ord", "event_id as number")
    return captures.set_numbers(rows, edits).select("book_id", "page_ord", "printed_number", "number_manual")


@query(oracle("select book_id, page_ord, case when page_ord = 3 then 'cover' end as role, row_number() over (partition by book_id order by page_ord = 3 desc, page_ord) as new_ord from captures", "captures"))
def set_cover(spark, sf_dir):
    rows = fx.captures(spark, sf_dir)
    return captures.set_cover(rows, rows.where("page_ord = 3").select("book_id", "page_ord")).select("book_id", "page_ord", "role", "new_ord")


QUEUE = f"""select book_id, number, kind, row_number() over (partition by book_id order by number nulls last, k, page_ord) as pos from (
 select book_id, n as number, 'missing' as kind, 0 as k, null as page_ord from lack union all
 select book_id, printed_number, 'reshoot', 1, page_ord from reasoned where status not in ('duplicate', 'deleted') and transcribe_error is null and not (has_region and not has_crop and not ({WORK}))
 and len(list_filter(found, lambda x: not starts_with(x, 'note:') and x <> 'no_crop')) > 0)"""


@query(oracle(QUEUE, "review_pages", have=HAVE, lack=LACK, listed=LISTED, reasoned=REASONED))
def capture_queue(spark, sf_dir):
    from leafmill.plans.core import _flagged

    pages = _flagged(spark, sf_dir)
    work = review.work_queues(pages).where("queue = 'reshoot'").join(pages.select("book_id", "page_ord", "printed_number"), ["book_id", "page_ord"])
    return captures.capture_queue(sequence.missing_numbers(fx.captures(spark, sf_dir)), work)


@query("select l_orderkey as page, l_partkey as box, bool_or((l_quantity / 50) * (0.6 + l_discount * 4) > 0.85 or (l_quantity / 50 > 0.93 and 0.6 + l_discount * 4 > 0.93)) as whole from lineitem group by 1, 2")
def whole_page_boxes(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_partkey as box", "0.0D as x0", "0.0D as y0", "l_quantity / 50 as x1", "0.6 + l_discount * 4 as y1")
    return rows.groupBy("page", "box").agg(F.bool_or(captures.whole_page_box()).alias("whole"))


@query("select doc_id % 10 as \"group\", doc_id as id, row_number() over (partition by doc_id % 10 order by case when doc_id % 7 = 0 then -1 else n_chars end desc, doc_id) = 1 as kept from documents")
def keep_sharpest(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "documents").selectExpr("doc_id % 10 as `group`", "doc_id as id", "if(doc_id % 7 = 0, null, cast(n_chars as double)) as sharpness")
    return captures.keep_sharpest(rows)


@query("select source as book_id, 'p' || doc_id as id, unnest(case when doc_id % 2 = 0 then [0, 2] else [0] end) as region from documents where doc_id % 3 > 0")
def uncropped_regions(spark, sf_dir):
    regions = "if(doc_id % 2 = 0, array(named_struct('deleted', false), named_struct('deleted', true), named_struct('deleted', null)), array(named_struct('deleted', false), named_struct('deleted', false)))"
    figures = "if(doc_id % 3 = 0, array(concat('figures/p', doc_id, '_a.png'), concat('figures/p', doc_id, '_b.png'), concat('figures/p', doc_id, '_c.png')), array(concat('figures/p', doc_id, '_b.png')))"
    rows = fx.load(spark, sf_dir, "documents").selectExpr("source as book_id", "concat('p', doc_id) as id", f"{regions} as regions", f"{figures} as figures")
    return captures.uncropped_regions(rows)


@query("select doc_id as id, case when doc_id % 3 = 0 then 'new0,gap,old2' else 'new0' end as regions from documents")
def merge_regions(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents")
    one = lambda name, user: f"named_struct('name', '{name}', 'user_crop', {user}, 'own_image', false)"
    old = docs.where("doc_id % 3 = 0").selectExpr("doc_id as id", f"array({one('old0', 'false')}, {one('old1', 'false')}, {one('old2', 'true')}) as regions")
    new = docs.selectExpr("doc_id as id", f"array({one('new0', 'false')}) as regions")
    names = F.array_join(F.transform("regions", lambda r: F.coalesce(r["name"], F.lit("gap"))), ",")
    return captures.merge_regions(old, new).select("id", names.alias("regions"))


_OVERLAP = "greatest(0.0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0)) * greatest(0.0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0))"
_AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
#: Of boxes of one page and name that with the smallest corners.
BOXES = "select * from regions qualify row_number() over (partition by page, box order by x0, y0, x1, y1) = 1"


def _single(boxes):
    w = Window.partitionBy("page", "box").orderBy("x0", "y0", "x1", "y1")
    return boxes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query(
    oracle(
        "select page, unnest(chosen).region as region, unnest(chosen).box as box from (select *, row_number() over (partition by page order by i desc) as last from w) where last = 1 and len(chosen) > 0",
        "regions",
        boxes=BOXES,
        pairs=f"select a.page, a.box as region, b.box, {_OVERLAP.format('a', 'b')} as inter, {_AREA.format('a')} + {_AREA.format('b')} as areas, {_AREA.format('b')} as area from (select page, box, x0, y0, x1 * 0.9 as x1, y1 from boxes where box % 2 = 0) a join boxes b on a.page = b.page and b.box % 2 = 1",
        own="select page, region, list({'box': box, 'iou': case when areas - inter > 0 then inter / (areas - inter) else 0 end, 'area': area} order by box) as own, row_number() over (partition by page order by region) as i from pairs group by page, region",
        w="""select page, cast(0 as bigint) as i, cast([] as struct(region bigint, box bigint)[]) as chosen from (select distinct page from own) union all
 select page, i, case when len(near) > 0 then list_append(chosen, {'region': region, 'box': list_sort(list_transform(near, lambda p: {'k': -p.iou, 'b': p.box}))[1].b}) when len(free) > 0 then list_append(chosen, {'region': region, 'box': list_sort(list_transform(free, lambda p: {'k': -p.area, 'b': p.box}))[1].b}) else chosen end
 from (select *, list_filter(free, lambda p: p.iou > 0.05) as near from (select w.page, own.i, chosen, region, list_filter(own, lambda p: not list_contains(list_transform(chosen, lambda c: c.box), p.box)) as free from w join own on own.page = w.page and own.i = w.i + 1))""",
    ).replace("with ", "with recursive ", 1)
)
def greedy_boxes(spark, sf_dir):
    boxes = _single(fx.regions(spark, sf_dir))
    regions = boxes.where("box % 2 = 0").withColumnRenamed("box", "region").withColumn("x1", F.col("x1") * 0.9)
    return captures.greedy_boxes(regions, boxes.where("box % 2 = 1"))


@query(
    oracle(
        "select page, unnest(taken).box as box from (select *, row_number() over (partition by page order by i desc) as last from w) where last = 1",
        "regions",
        boxes=BOXES,
        own=f"select *, {_AREA.format('boxes')} as area, row_number() over (partition by page order by -{_AREA.format('boxes')}, box) as i from boxes",
        w="""select page, cast(1 as bigint) as i, [{'box': box, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area}] as taken from own where i = 1 union all
 select o.page, o.i, case when len(list_filter(taken, lambda t: case when o.area + t.area - (greatest(least(o.x1, t.x1) - greatest(o.x0, t.x0), 0) * greatest(least(o.y1, t.y1) - greatest(o.y0, t.y0), 0)) > 0
  then (greatest(least(o.x1, t.x1) - greatest(o.x0, t.x0), 0) * greatest(least(o.y1, t.y1) - greatest(o.y0, t.y0), 0)) / (o.area + t.area - (greatest(least(o.x1, t.x1) - greatest(o.x0, t.x0), 0) * greatest(least(o.y1, t.y1) - greatest(o.y0, t.y0), 0))) else 0 end >= 0.6)) = 0
  then list_append(taken, {'box': o.box, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'area': o.area}) else taken end from w join own o on o.page = w.page and o.i = w.i + 1""",
    ).replace("with ", "with recursive ", 1)
)
def candidate_boxes(spark, sf_dir):
    return captures.candidate_boxes(_single(fx.regions(spark, sf_dir)))


@query(
    oracle(
        "select label, id, leader from w",
        hashes=HASH,
        own="select label, id, ('0x' || hash[1:8])::bigint as hi, ('0x' || hash[9:16])::bigint as lo, row_number() over (partition by label order by id) as i from hashes",
        w="""select label, i, id, id as leader, [{'id': id, 'hi': hi, 'lo': lo}] as leaders from own where i = 1 union all
 select label, i, id, coalesce(found, id), case when found is null then list_append(leaders, {'id': id, 'hi': hi, 'lo': lo}) else leaders end from
 (select o.*, leaders, list_min(list_transform(list_filter(leaders, lambda l: bit_count(xor(l.hi, o.hi)) + bit_count(xor(l.lo, o.lo)) <= 20), lambda l: l.id)) as found from w join own o on o.label = w.label and o.i = w.i + 1)""",
    ).replace("with ", "with recursive ", 1)
)
def figure_clusters(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), resolve.sign_hash("embedding").alias("hash"))
    return captures.figure_clusters(rows, 20)


@query("select doc_id as id, case when doc_id % 4 = 0 then '# Part' || chr(10) || chr(10) else '' end || 'Text of page ' || doc_id || '.' as markdown, 'high' as confidence, cast(null as varchar) as transcribe_error, case when doc_id % 5 = 0 or doc_id % 11 = 0 then 'mock_strong' else 'mock' end as read_by from documents")
def read_pages(spark, sf_dir):
    return captures.read_pages(fx.load(spark, sf_dir, "documents").selectExpr("doc_id as id", "cast(text as binary) as image"))


WORDS20 = "['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen', 'twenty']"


@query(
    "select n_regionkey as book_id, n_nationkey as ch_no, case when n_nationkey % 4 = 0 and n_regionkey > 0 and n_nationkey between 1 and 20 then (case n_regionkey % 2 when 1 then upper(w) else upper(w[1:1]) || w[2:] end)"
    f" when n_nationkey % 4 = 0 then 'Chapter ' || n_nationkey when n_regionkey = 0 then 'Prologue' when n_nationkey between 1 and 20 then (case n_regionkey % 2 when 1 then upper(w) else upper(w[1:1]) || w[2:] end) else 'Else' end as title from (select *, {WORDS20}[n_nationkey] as w from nation)"
)
def restyled_titles(spark, sf_dir):
    from leafmill.functions.text import number_title
    from leafmill.operators import assemble

    rows = fx.load(spark, sf_dir, "nation").selectExpr("n_regionkey as book_id", "n_nationkey as ch_no", "n_nationkey % 4 = 0 as inserted")
    own = F.when(F.col("book_id") == 0, "Prologue").when(F.col("ch_no").between(1, 20), number_title(F.col("ch_no"), F.when(F.col("book_id") % 2 == 1, "caps").otherwise("title"))).otherwise("Else")
    rows = rows.withColumn("title", F.when(F.col("inserted"), F.concat(F.lit("Chapter "), "ch_no")).otherwise(own))
    return assemble.restyle_titles(rows).select("book_id", "ch_no", "title")


@query("select doc_id, cast(doc_id % 4 as int) as idx, case when doc_id % 3 = 0 then doc_id % 20 else doc_id % 4 end as ch_idx from documents")
def cast_chapters(spark, sf_dir):
    from leafmill.operators import narrate

    docs = fx.load(spark, sf_dir, "documents")
    titled = spark.range(20).selectExpr("0 as book_id", "id as ch_idx", "concat('T', id) as title")
    rows = docs.selectExpr("doc_id", "0 as book_id", "cast(doc_id % 4 as int) as idx", "if(doc_id % 3 = 0, concat('T', doc_id % 20), 'none') as title")
    return narrate.by_title_or_place(rows, titled).select("doc_id", "idx", "ch_idx")


@query("select c_nationkey as book_id, c_custkey as voice, case when c_custkey % 2 = 0 then 'own' when c_custkey % 3 = 0 then 'shared' end as path from customer")
def voice_paths(spark, sf_dir):
    from leafmill.operators import narrate

    wanted = fx.load(spark, sf_dir, "customer").selectExpr("c_nationkey as book_id", "c_custkey as voice")
    own = wanted.where("voice % 2 = 0").withColumn("path", F.lit("own"))
    return narrate.resolve_voices(wanted, own, wanted.where("voice % 3 = 0").select("voice", F.lit("shared").alias("path")))


@query(
    "select conv_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || s || chr(10) || 'END=' || e || chr(10) || 'title=a\\=' || turn, chr(10) order by turn) || chr(10) as metadata from"
    " (select conv_id, turn, cast(floor(round(coalesce(sum(d) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) * 1000, 6)) as bigint) as s, cast(floor(round(sum(d) over (partition by conv_id order by turn) * 1000, 6)) as bigint) as e from (select conv_id, turn, length(text) / 16.0 / 1.25 as d from conversations)) group by 1"
)
def chapter_metadata(spark, sf_dir):
    from leafmill.operators import narrate

    rows = fx.load(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "concat('a=', turn) as title", "length(text) / 16.0D as seconds")
    return narrate.chapter_metadata(rows, ["conv_id"], "turn", 1.25)


@query("select doc_id, abs(length(text) // 2 - length(text)) > greatest(200.0, length(text) * 0.05) as heavy from documents")
def heavy_edits(spark, sf_dir):
    from leafmill.functions.text import heavy

    return fx.load(spark, sf_dir, "documents").select("doc_id", heavy(F.col("text"), F.expr("left(text, length(text) div 2)")).alias("heavy"))


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(least(1.0, 1404 / (l_quantity * 100), 1872 / (l_extendedprice / 10)), 6) as fit from lineitem")
def device_fits(spark, sf_dir):
    from leafmill.functions.text import device_fit

    rows = fx.load(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(device_fit(F.col("l_quantity") * 100, F.col("l_extendedprice") / 10, 1404, 1872), 6).alias("fit"))


@query("select event_id, case event_id % 4 when 0 then 'true' when 1 then 'false' end as down from events")
def orientation_replies(spark, sf_dir):
    from leafmill.functions.text import upside_down

    reply = F.expr("case event_id % 4 when 0 then 'ok {\"upside_down\": true}' when 1 then '{\"upside_down\": false}' when 2 then '{\"upside_down\": \"yes\"}' else 'none' end")
    return fx.load(spark, sf_dir, "events").select("event_id", upside_down(reply).cast("string").alias("down"))


@query("select doc_id, case when doc_id % 2 = 0 then 'A caption' end as caption, case when doc_id % 3 = 0 then '- [One 4](c1.xhtml)' else '- One 4' end as link from documents")
def captions_and_links(spark, sf_dir):
    from leafmill.functions.text import figure_caption, toc_link

    docs = fx.load(spark, sf_dir, "documents")
    after = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("say a CAPTION. "), F.col("text")))
    return docs.select("doc_id", figure_caption(after, F.lit("A caption")).alias("caption"), toc_link(F.lit("One"), F.lit(4), F.when(F.col("doc_id") % 3 == 0, "c1.xhtml")).alias("link"))

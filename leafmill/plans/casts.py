"""Queries of cast analysis, of EPUB archives, and of the smaller rules on replies and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import replies, text
from leafmill.operators import captures, casting
from leafmill.plans import fixtures as fx
from leafmill.plans.fixtures import oracle
from leafmill.plans.proofing import FIRST, PHRASE
from leafmill.sources import epub, sinks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def chapters(spark, sf_dir):
    return fx.load(spark, sf_dir, "documents").selectExpr("source as book_id", "doc_id as ch_idx", "concat('Chapter ', doc_id) as title", "coalesce(text, '') as text")


def _read(windows):
    """Analyses: whole, cut off, none, broken, or no answer in time; those of later windows are of no use."""
    quote = lambda q, who: f"concat('{{\"quote\": \"', {q}, '\", \"speaker\": \"{who}\"}}')"
    whole = f"concat('{{\"characters\": [{{\"name\": \" Ann \", \"description\": \"tall\"}}, {{\"name\": \"\"}}], \"quotes\": [', {quote('q', 'Ann')}, ', {{\"quote\": \"short\", \"speaker\": \"Bo\"}}, {{\"quote\": \"zz not there zz\", \"speaker\": \"Bo\"}}, ', {quote('lower(q)', '')}, ']}}')"
    cut = f"concat('{{\"characters\": [{{\"name\": \"Ann\", \"description\": \"tall\"}}, {{\"name\": \"Bo\"}}], \"quotes\": [', {quote('q', 'Ann')}, ', {{\"quo')"
    reply = f"case when w > 0 then 'none here' else case ch_idx % 9 when 4 then null when 5 then {cut} when 6 then 'nothing to say' when 7 then '{{\"quotes\": [[}}' else {whole} end end"
    return windows.selectExpr("*", f"{FIRST} as q").selectExpr("book_id", "ch_idx", "w", f"{reply.replace('{{', '{').replace('}}', '}')} as reply", "if(w = 0 and ch_idx % 9 = 4, 'timeout', null) as failure")


def _previous(rows):
    return rows.where("ch_idx % 2 = 0").selectExpr(
        "book_id", "ch_idx", "title", "array(named_struct('q', 'old quote', 'speaker', 'Old')) as quotes", "array(named_struct('name', 'Old', 'description', '', 'sounds_like', '')) as characters", "if(ch_idx % 4 = 0, 'old', null) as error"
    )


MODES = "(select *, case mode when 'all' then true when 'failed' then ch_idx % 2 = 1 or ch_idx % 4 = 0 else ch_idx % 3 = 0 end as again from (select doc_id as ch_idx, regexp_extract(coalesce(text, ''), '" + PHRASE + "') as q from documents), (values ('all'), ('failed'), ('chapters')) m(mode))"


@query(
    "select mode, ch_idx, case when again then case when q = '' or ch_idx % 9 in (4, 6, 7) then '' when ch_idx % 9 = 5 then 'Ann:' || q else 'Ann:' || q || '|NARRATOR:' || lower(q) end when ch_idx % 2 = 0 then 'Old:old quote' else '' end as quotes,"
    " case when again then case when ch_idx % 9 in (4, 6, 7) then '' when ch_idx % 9 = 5 then 'Ann,Bo' else 'Ann' end when ch_idx % 2 = 0 then 'Old' else '' end as names,"
    f" case when again then case ch_idx % 9 when 4 then 'timeout' when 6 then 'no_json' when 7 then 'bad_json' end when ch_idx % 4 = 0 then 'old' end as error from {MODES}"
)
def analysed_book(spark, sf_dir):
    rows = chapters(spark, sf_dir)
    out = None
    for mode in ("all", "failed", "chapters"):
        done = casting.analyse(rows, _previous(rows), _read, mode, rows.where("ch_idx % 3 = 0")).withColumn("mode", F.lit(mode))
        out = done if out is None else out.unionByName(done)
    quotes = F.array_join(F.transform("quotes", lambda q: F.concat(q["speaker"], F.lit(":"), q["q"])), "|")
    return out.select("mode", "ch_idx", quotes.alias("quotes"), F.array_join("characters.name", ",").alias("names"), "error")


@query(
    f"select book_id, 'Ann' as name, count(*) as quotes, 'tall' as description, string_agg(q, '|' order by ch_idx) filter (r <= 3) as samples, case when book_id in ('src1', 'src2') then 'v1' else '' end as voice from"
    f" (select *, row_number() over (partition by book_id order by ch_idx) as r from (select source as book_id, doc_id as ch_idx, regexp_extract(coalesce(text, ''), '{PHRASE}') as q from documents) where q <> '' and ch_idx % 9 not in (4, 6, 7)) group by 1"
)
def cast_people(spark, sf_dir):
    rows = chapters(spark, sf_dir)
    voices = rows.where("book_id in ('src1', 'src2')").selectExpr("book_id", "'Ann' as name", "'v1' as voice").distinct()
    out = casting.people(casting.analyse(rows, _previous(rows), _read), voices)
    return out.select("book_id", "name", "quotes", "description", F.array_join("samples", "|").alias("samples"), "voice")


_WORDS = "array_to_string(regexp_extract_all(coalesce(html, ''), '[A-Za-z]{3,}'), ' ')"


@query(
    "select cast(book as varchar) as path, cast(row_number() over (partition by book order by page_id) - 1 as int) as page_ord, 'p' || lpad(cast(row_number() over (partition by book order by page_id) as varchar), 4, '0') as page_id, 'Book ' || book as title, sha1(text) as digest from"
    f" (select page_id, page_id % 20 as book, '# Page ' || page_id || case when words <> '' then chr(10) || chr(10) || words else '' end as text from (select page_id, {_WORDS} as words from pages) where length(regexp_replace('Page' || page_id || words, '[^A-Za-z0-9]', '', 'g')) >= 20)"
)
def epub_round_trip(spark, sf_dir):
    """Archives written from pages, and their pages as they are read back."""
    words = "array_join(regexp_extract_all(coalesce(html, ''), '[A-Za-z]{3,}', 0), ' ')"
    rows = fx.load(spark, sf_dir, "pages").selectExpr("page_id % 20 as book_id", "concat('Book ', page_id % 20) as book_title", "cast(page_id as int) as ch_idx", "concat('Page ', page_id) as title", f"concat('# Page ', page_id, '\\n\\n', {words}) as text")
    archives = sinks.epubs(rows).selectExpr("cast(book_id as string) as path", "epub as content")
    return epub.pages(archives).select("path", "page_ord", "page_id", "title", F.sha1(F.col("text").cast("binary")).alias("digest"))


@query(
    "select doc_id, sha1(case when a = '' then b when b = '' then a when a like '%-' then a[:-2] || b when right(a, 1) not in ('.', '!', '?', ':', ';', '\"', '''', ')', ']', '}') and not regexp_matches(b, '^((#{1,6}|[-*+]|[0-9]+[.)])[ \t]|>)') then a || ' ' || b else a || chr(10) || chr(10) || b end) as digest"
    " from (select doc_id, trim(substring(t, 1, length(t) // 2), ' ' || chr(10) || chr(9) || chr(13)) as a, trim(substring(t, length(t) // 2 + 1), ' ' || chr(10) || chr(9) || chr(13)) as b from (select doc_id, coalesce(text, '') as t from documents))"
)
def joined_halves(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') as t").selectExpr("doc_id", "array(substring(t, 1, cast(length(t) div 2 as int)), null, substring(t, cast(length(t) div 2 as int) + 1)) as parts")
    return rows.select("doc_id", F.sha1(text.join_halves(F.col("parts")).cast("binary")).alias("digest"))


@query(
    "select doc_id, 'A speaker with this character: ' || case when a = '' and b = '' then 'a neutral, pleasant adult voice' when a = '' then b when b = '' then a else a || '; ' || b end || '. Moderate pace, expressive but controlled delivery, very clear audio, close-up recording with no background noise.' as prompt"
    f" from (select doc_id, case doc_id % 4 when 0 then 'A gruff man' when 1 then 'warm, old' when 2 then '' else '' end as a, case when doc_id % 3 = 0 then '' else regexp_extract(coalesce(text, ''), '{PHRASE}') end as b from documents)"
)
def voice_descriptions(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "documents").selectExpr("doc_id", "case doc_id % 4 when 0 then ' A gruff man. ' when 1 then 'warm — like Mary Poppins of London, old' when 2 then '...' end as a", f"if(doc_id % 3 = 0, 'similar to Someone', {FIRST.replace('text', chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) as b")
    return rows.select("doc_id", text.voice_description(F.col("a"), F.col("b")).alias("prompt"))


@query(
    "with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.0, least(1.0, cast(l_discount * 10 - 0.25 as double))) as x0, cast(0.5 as double) as y0, greatest(0.0, least(1.0, cast(l_tax * 10 + 0.2 as double))) as x1, cast(1 as double) as y1 from lineitem)"
    " select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when x1 - x0 > 0.03 then 1 else 0 end as n, case when x1 - x0 > 0.03 then x1 - x0 end as width, case when x1 - x0 > 0.03 then 'c' || l_partkey end as caption from b"
)
def model_figure_boxes(spark, sf_dir):
    reply = "concat('```json {\"figures\": [{\"bbox\": [', cast(l_discount as double) * 10 - 0.25D, ', 0.5, ', cast(l_tax as double) * 10 + 0.2D, ', 7], \"caption\": \"c', l_partkey, '\"}, {\"bbox\": [0, 0, 1]}, {\"bbox\": [\"a\", 0, 1, 1]}, {\"bbox\": [0, 0, 1, 0.01]}, 4]}```')"
    rows = fx.load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{reply} as reply")
    found = rows.withColumn("f", replies.figure_boxes(F.col("reply")))
    box = F.get("f", 0)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("f").alias("n"), (box["bbox"][2] - box["bbox"][0]).alias("width"), box["caption"].alias("caption"))


@query(
    "select book_id, arg_min(isbn, ch_idx) as isbn from (select source as book_id, doc_id as ch_idx, cast(978000000000 + doc_id * 7919 as varchar) || doc_id % 10 as isbn from documents)"
    " where ch_idx % 7 > 0 and list_sum(list_transform(range(1, 14), lambda i: cast(isbn[i] as int) * (case when i % 2 = 1 then 1 else 3 end))) % 10 = 0 group by 1"
)
def found_isbns(spark, sf_dir):
    """The first labelled number of each book that is valid; some pages don't count."""
    number = "concat(cast(978000000000 + doc_id * 7919 as string), cast(doc_id % 10 as string))"
    rows = fx.load(spark, sf_dir, "documents").selectExpr("source as book_id", "doc_id as page_ord", "if(doc_id % 7 = 0, 'duplicate', null) as status", f"concat(coalesce(text, ''), ' LCCN 1234567890, isbn – ', substring({number}, 1, 3), '-', substring({number}, 4), ' (cloth)') as text")
    return captures.first_isbn(rows)


_IOU = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_UNION = f"((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU})"


@query(
    oracle(
        f"select page, k, round(iou, 9) as iou, row_number() over (partition by page order by round(iou, 9) desc, k) as pos from (select a.page, a.box as k, case when {_UNION} > 0 then {_IOU} / {_UNION} else 0 end as iou from one a join one b on b.page = a.page and b.r = 1)",
        "regions",
        one="select *, row_number() over (partition by page order by box, x0, y0, x1, y1) as r from regions qualify row_number() over (partition by page, box order by x0, y0, x1, y1) = 1",
    )
)
def ranked_candidates(spark, sf_dir):
    boxes = fx.regions(spark, sf_dir)
    one = boxes.withColumn("r", F.row_number().over(Window.partitionBy("page", "box").orderBy("x0", "y0", "x1", "y1"))).where("r = 1").drop("r")
    prior = one.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy("box"))).where("r = 1").drop("r", "box")
    return captures.by_prior(one.withColumnRenamed("box", "k"), prior).select("page", "k", F.round("iou", 9).alias("iou"), "pos")

"""Queries of the proof workflow over documents as chapters and their pieces as pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.text import chapter_hash
from leafmill.operators import proofflow
from leafmill.plans import fixtures as fx
from leafmill.plans.fixtures import oracle
from leafmill.sources.shared import kept

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Three words of a text; the first such are quoted.
PHRASE = "[A-Za-z]{4,} [A-Za-z]{4,} [A-Za-z]{4,}"
FIRST = f"regexp_extract(text, '({PHRASE})', 1)"


def chapters(spark, sf_dir):
    title = "if(doc_id % 11 = 0, 'Index', concat('Part ', doc_id))"
    return fx.load(spark, sf_dir, "documents").selectExpr("source as book_id", "doc_id as ch_idx", f"{title} as title", "coalesce(text, '') as text")


def changed_chapters(spark, sf_dir):
    """The same after a rebuild: some begin with more, some lost their first phrase, some stand elsewhere; all have new titles."""
    word = f"split_part({FIRST}, ' ', 1)"
    text = f"case when ch_idx % 3 = 0 then concat('Preface.\\n\\n', text) when ch_idx % 3 = 1 and {FIRST} <> '' then replace(text, {word}, 'zzzz') else text end"
    return chapters(spark, sf_dir).selectExpr("book_id", "if(ch_idx % 17 = 0, ch_idx + 1000000, ch_idx) as ch_idx", "concat('New ', title) as title", f"{text} as text")


def pages(texts):
    cut = "explode(sequence(0L, cast((length(text) - 1) div 900 as bigint)))"
    rows = texts.where("text <> ''").selectExpr("book_id", "ch_idx", "text", f"{cut} as k")
    return rows.selectExpr("book_id", "ch_idx * 1000000 + k as page_ord", "concat('p', ch_idx * 1000000 + k) as page_id", "ch_idx + k as printed_number", "substring(text, cast(1 + 900 * k as int), 900) as text", "if(k % 2 = 0, 'image', null) as image")


PAGES = "select book_id, ch_idx * 1000000 + k as page_ord, k % 2 = 0 as shown, regexp_replace(lower(substring(text, 1 + 900 * k, 900)), '[^a-z0-9]', '', 'g') as body from (select *, unnest(range(0, (length(text) - 1) // 900 + 1)) as k from {0} where text <> '')"
CHAPTERS = f"select source as book_id, doc_id as ch_idx, coalesce(text, '') as text, regexp_extract(coalesce(text, ''), '{PHRASE}') as q from documents"
HASH = "sha1(trim({0}, ' ' || chr(10)))[1:16]"


def count(text: str, quote: str) -> str:
    return f"(case when length({quote}) > 0 then (length({text}) - length(replace({text}, {quote}, ''))) // length({quote}) else 0 end)"


def page_of(quote: str, pages: str, book: str) -> str:
    return f"(select min(page_ord) from {pages} p where p.book_id = {book} and length(regexp_replace(lower({quote}), '[^a-z0-9]', '', 'g')) >= 12 and contains(p.body, regexp_replace(lower({quote}), '[^a-z0-9]', '', 'g')))"


def replies(spark, sf_dir):
    """Reviews of the chapters: whole, fenced, cut off, or no JSON at all."""
    one = "to_json(named_struct('type', 'ocr', 'severity', 'high', 'quote', q, 'replacement', concat(q, 'x'), 'note', 'seen'))"
    parts = f"concat('{{\"findings\": [', {one}, ', {{\"quote\": \"and\", \"replacement\": \"&\"}}, ')"
    reply = f"case ch_idx % 6 when 4 then 'nothing to say' when 2 then concat({parts}, '{{\"quo') when 1 then concat('```json\\n', {parts}, '{{\"type\": \"x\"}}]}}\\n```') else concat({parts}, '{{\"quote\": 7}}]}}') end"
    return chapters(spark, sf_dir).selectExpr("*", f"{FIRST} as q").where("ch_idx % 6 <> 5").selectExpr("book_id", "ch_idx", f"{reply} as reply")


_WORD = "[\\p{L}\\p{N}\\p{M}_]"
LINTED = {
    "c": CHAPTERS,
    "marks": "select ch_idx, 1 as part, i as n, 'lint' as source, 'formatting' as type, 'high' as severity, m as quote, cast(null as varchar) as replacement from (select ch_idx, unnest(l) as m, unnest(range(1, len(l) + 1)) as i from (select ch_idx, regexp_extract_all(text, '\\[\\[region-\\d+\\]\\]') as l from c))",
    "bad": "select ch_idx, 2 as part, i as n, 'lint', 'ocr', 'medium', substring(m, 1, 120), null from (select ch_idx, unnest(l) as m, unnest(range(1, len(l) + 1)) as i from (select ch_idx, list_sort(list_distinct(regexp_extract_all(text, '[^\\s]*' || chr(65533) || '[^\\s]*'))) as l from c)) where i <= 9",
    "tokens": f"select ch_idx, unnest(w) as w, unnest(list_concat(s[2:], [''])) as s, unnest(range(1, len(w) + 1)) as i from (select ch_idx, regexp_extract_all(text, '{_WORD}+') as w, regexp_split_to_array(text, '{_WORD}+') as s from c)",
    "pairs": "select *, lead(w) over (partition by ch_idx order by i) as w2, length(w) >= 3 and lower(w) = lower(lead(w) over (partition by ch_idx order by i)) and trim(s, ' ' || chr(10) || chr(9) || chr(13)) = '' and s <> '' as same from tokens",
    "runs": "select *, i - row_number() over (partition by ch_idx order by i) as run from pairs where same",
    "twice": "select ch_idx, 3 as part, i as n, 'lint', 'ocr', 'low', substring(w || s || w2, 1, 120), null from (select *, row_number() over (partition by ch_idx, run order by i) as r from runs) where r % 2 = 1",
    "paras": "select ch_idx, p[i] as a, p[i + 1] as b, i from (select ch_idx, p, unnest(range(1, len(p))) as i from (select ch_idx, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 80) as p from c))",
    "again": "select ch_idx, 4 as part, i as n, 'lint', 'continuity', 'high', substring(a, 1, 120), null from paras where a = b",
    "linted": "select * from (from marks union all from bad union all from twice union all from again) qualify row_number() over (partition by ch_idx order by part, n) <= 40",
    "said": "select ch_idx, 5 as part, 1 as n, 'model', 'ocr', 'high', q, q || 'x' from c where ch_idx % 6 not in (4, 5) and q <> '' union all select ch_idx, 5, 2, 'model', 'other', 'low', 'and', '&' from c where ch_idx % 6 not in (4, 5) union all select ch_idx, 5, 3, 'model', 'other', 'low', '7', null from c where ch_idx % 6 in (0, 3)",
}


@query(oracle("select ch_idx, cast(row_number() over (partition by ch_idx order by part, n) - 1 as int) as f_idx, source, type, severity, quote, replacement from (from linted union all from said)", **LINTED))
def proof_findings(spark, sf_dir):
    rows = proofflow.findings(chapters(spark, sf_dir), replies(spark, sf_dir), names=False)
    return rows.select("ch_idx", F.posexplode("findings").alias("f_idx", "f")).select("ch_idx", "f_idx", *(f"f.{c}" for c in ("source", "type", "severity", "quote", "replacement")))


@query()
def proofread_chapters(spark, sf_dir):
    """Everything together; rare names are beyond SQL, and a test compares this with a plain version."""
    texts = chapters(spark, sf_dir)
    proofs = proofflow.proofread(texts, pages(texts), replies(spark, sf_dir))
    return proofs.select("book_id", "ch_idx", "base_hash", "status", "applied", "heavy", F.sha1(F.col("proofed").cast("binary")).alias("digest"), F.to_json("findings").alias("findings"))


def stored_proofs(spark, sf_dir):
    """Proofs as stored before: a fix of the first phrase, one of 'and' that some rejected, and a note on the second phrase."""
    struct = lambda quote, new, rejected, n: f"named_struct('source', 'model', 'type', 'ocr', 'severity', 'low', 'quote', {quote}, 'replacement', {new}, 'note', 'n{n}', 'apply_all', false, 'reference', false, 'user_edit', false, 'rejected', {rejected}, 'version', 0, 'applied', false, 'skip_reason', cast(null as string), 'page', cast(null as string), 'printed_number', cast(null as bigint))"
    second = f"coalesce(get(regexp_extract_all(text, '({PHRASE})', 1), 1), '')"
    made = f"array({struct(FIRST, f'concat({FIRST}, chr(120))', 'false', 0)}, {struct(chr(39) + 'and' + chr(39), chr(39) + '&' + chr(39), 'ch_idx % 5 = 0', 1)}, {struct(second, 'cast(null as string)', 'false', 2)})"
    rows = chapters(spark, sf_dir).where("ch_idx % 13 <> 0").withColumn("findings", F.expr(made).cast(f"array<{proofflow.FINDING}>"))
    rows = rows.withColumn("base_hash", F.when(F.col("ch_idx") % 7 == 0, F.lit("old")).otherwise(chapter_hash(F.col("text"))))
    return kept(proofflow.rebuilt(rows.withColumn("status", F.lit("review"))).select(*proofflow.PROOF))


def changes(spark, sf_dir):
    each = """inline(array(
      named_struct('seq', 1L, 'f_idx', 1, 'version', 0, 'enabled', true, 'apply_all', true, 'set_replacement', false, 'replacement', cast(null as string)),
      named_struct('seq', 2L, 'f_idx', 1, 'version', 0, 'enabled', false, 'apply_all', false, 'set_replacement', false, 'replacement', cast(null as string)),
      named_struct('seq', 3L, 'f_idx', 1, 'version', 1, 'enabled', true, 'apply_all', true, 'set_replacement', false, 'replacement', cast(null as string)),
      named_struct('seq', 4L, 'f_idx', 2, 'version', cast(null as int), 'enabled', true, 'apply_all', true, 'set_replacement', true, 'replacement', 'NEW'),
      named_struct('seq', 5L, 'f_idx', 9, 'version', 0, 'enabled', true, 'apply_all', false, 'set_replacement', false, 'replacement', cast(null as string))))"""
    return chapters(spark, sf_dir).selectExpr("book_id", "ch_idx", each).where("seq <= 3 or (seq = 4 and ch_idx % 2 = 0) or (seq = 5 and ch_idx % 3 = 0)")


STATE = {
    "c": CHAPTERS.replace("as q from", f"as q, coalesce(regexp_extract_all(coalesce(text, ''), '{PHRASE}')[2], '') as q2 from"),
    "t0": f"select *, {count('text', 'q')} = 1 as a0, case when {count('text', 'q')} = 1 then replace(text, q, q || 'x') else text end as x0 from c",
}
OPEN = "c.ch_idx % 13 <> 0 and c.ch_idx % 7 <> 0"


@query(
    oracle(
        "select c.ch_idx, n as seq, cast(case n when 4 then 2 when 5 then 9 else 1 end as int) as f_idx, case when c.ch_idx % 13 = 0 then 'not_proofed' when c.ch_idx % 7 = 0 then 'stale' when n = 2 then 'conflict' when n = 3 then 'repeated' when n = 5 then 'no_finding' else 'applied' end as outcome"
        " from c, unnest(range(1, 6)) s(n) where n <= 3 or (n = 4 and c.ch_idx % 2 = 0) or (n = 5 and c.ch_idx % 3 = 0)",
        c=CHAPTERS,
    )
)
def proof_decision_outcomes(spark, sf_dir):
    return proofflow.decide(stored_proofs(spark, sf_dir), chapters(spark, sf_dir), changes(spark, sf_dir))[1].select("ch_idx", "seq", "f_idx", "outcome")


@query(
    oracle(
        f"select ch_idx, version1, cast(a0::int + a1::int + a2::int as int) as applied, sha1(x2) as digest from (select *, ch_idx % 2 = 0 and fresh and {count('x1', 'q2')} > 0 as a2, case when ch_idx % 2 = 0 and fresh and q2 <> '' then replace(x1, q2, 'NEW') else x1 end as x2"
        f" from (select *, cast(fresh as int) as version1, case when fresh then {count('x0', chr(39) + 'and' + chr(39))} > 0 else ch_idx % 5 <> 0 and {count('x0', chr(39) + 'and' + chr(39))} = 1 end as a1,"
        f" case when fresh or (ch_idx % 5 <> 0 and {count('x0', chr(39) + 'and' + chr(39))} = 1) then replace(x0, 'and', '&') else x0 end as x1 from (select *, ch_idx % 7 <> 0 as fresh from t0 where ch_idx % 13 <> 0)))",
        **STATE,
    )
)
def proof_decisions(spark, sf_dir):
    proofs, _ = proofflow.decide(stored_proofs(spark, sf_dir), chapters(spark, sf_dir), changes(spark, sf_dir))
    return proofs.select("ch_idx", F.get("findings", 1)["version"].alias("version1"), "applied", F.sha1(F.col("proofed").cast("binary")).alias("digest"))


def answers(work):
    """What a reader says of each passage: the same in capitals, nothing, something new, or blanks."""
    return work.selectExpr("book_id", "ch_idx", "f_idx", "case ch_idx % 4 when 0 then upper(quote) when 2 then concat(quote, 'y') when 3 then ' ' end as replacement")


ANDS = f"case when ch_idx % 5 <> 0 and {count('x0', chr(39) + 'and' + chr(39))} = 1 then replace(x0, 'and', '&') else x0 end"


@query(
    oracle(
        "select t.ch_idx, cast(1 as int) as attempted, cast((ch_idx % 4 = 2 and n = 1)::int as int) as rescued, cast(1 - (ch_idx % 4 = 2 and n = 1)::int as int) as still_manual, sha1(case when ch_idx % 4 = 2 and n = 1 then replace(x1, q2, q2 || 'y') else x1 end) as digest"
        " from t join pg on pg.book_id = t.book_id and pg.page_ord = t.page where pg.shown",
        **STATE,
        pg=PAGES.format("c"),
        t=f"select *, {count('x1', 'q2')} as n, {page_of('q2', 'pg', 't1.book_id')} as page from (select *, {ANDS} as x1 from t0 where ch_idx % 13 <> 0 and ch_idx % 7 <> 0) t1",
    )
)
def reread_findings(spark, sf_dir):
    texts = chapters(spark, sf_dir)
    proofs = kept(proofflow.anchored(stored_proofs(spark, sf_dir), pages(texts)).select(*proofflow.PROOF))
    new, report = proofflow.reread(proofs, texts, pages(texts), answers)
    return report.join(new, proofflow.KEY).select("ch_idx", "attempted", "rescued", "still_manual", F.sha1(F.col("proofed").cast("binary")).alias("digest"))


REFRESH = STATE | {
    "new": f"select book_id, ch_idx as old, case when ch_idx % 17 = 0 then ch_idx + 1000000 else ch_idx end as ch_idx, 'New ' || case when ch_idx % 11 = 0 then 'Index' else 'Part ' || ch_idx end as title, case when ch_idx % 3 = 0 then 'Preface.' || chr(10) || chr(10) || text when ch_idx % 3 = 1 and q <> '' then replace(text, split_part(q, ' ', 1), 'zzzz') else text end as text from c",
    "now": f"select *, {HASH.format('text')} as h from new",
    "pg": PAGES.format("now"),
    "stored": f"select t0.*, case when ch_idx % 7 = 0 then 'old' else {HASH.format('text')} end as base, 'Part ' || ch_idx as plain, {ANDS} as x1 from t0 where ch_idx % 13 <> 0",
    "home": "select s.book_id, s.ch_idx from stored s join now n on n.book_id = s.book_id and n.ch_idx = s.ch_idx and n.h = s.base",
    "lost": "select s.book_id, base, min(ch_idx) as ch_idx from stored s where not exists (from home h where h.book_id = s.book_id and h.ch_idx = s.ch_idx) group by 1, 2 having count(*) = 1",
    "free": "select book_id, h, min(ch_idx) as dest from now group by 1, 2 having count(*) = 1",
    "moves": "select l.book_id, l.ch_idx, dest from lost l join free f on f.book_id = l.book_id and f.h = l.base where dest <> l.ch_idx and not exists (from home h where h.book_id = l.book_id and h.ch_idx = dest)",
    "placed": "select s.*, coalesce(m.dest, s.ch_idx) as place from stored s left join moves m on m.book_id = s.book_id and m.ch_idx = s.ch_idx where m.dest is not null or not exists (from moves o where o.book_id = s.book_id and o.dest = s.ch_idx)",
    "merged": "select p.*, n.text as later, n.title as newer, n.h is not null and n.h <> p.base as stale, n.h as h from placed p left join now n on n.book_id = p.book_id and n.ch_idx = p.place",
    "r0": f"select *, {count('later', 'q')} as n0, case when {count('later', 'q')} = 1 then replace(later, q, q || 'x') else later end as y0 from merged",
    "r1": f"select *, case when ch_idx % 5 <> 0 and {count('y0', chr(39) + 'and' + chr(39))} = 1 then replace(y0, 'and', '&') else y0 end as y1 from r0",
}


@query(
    oracle(
        "select place as ch_idx, case when stale then newer when ch_idx % 11 = 0 then 'Index' else plain end as title, case when stale then h else base end as base_hash, sha1(case when stale then y1 else x1 end) as digest, ch_idx % 5 = 0 as rejected1,"
        f" case when q = '' then null when stale then case n0 when 1 then null when 0 then 'not_found' else 'ambiguous:' || n0 end else case {count('text', 'q')} when 1 then null else 'ambiguous:' || {count('text', 'q')} end end as skip0,"
        f" case when stale then 'p' || {page_of('q', 'pg', 'r1.book_id')} end as page0 from r1",
        **REFRESH,
    )
)
def refresh_proofs(spark, sf_dir):
    later = changed_chapters(spark, sf_dir)
    out = proofflow.refresh(stored_proofs(spark, sf_dir), later, pages(later))
    first, second = F.get("findings", 0), F.get("findings", 1)
    return out.select("ch_idx", "title", "base_hash", F.sha1(F.col("proofed").cast("binary")).alias("digest"), second["rejected"].alias("rejected1"), first["skip_reason"].alias("skip0"), first["page"].alias("page0"))

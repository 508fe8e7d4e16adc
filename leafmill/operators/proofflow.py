"""The proof workflow: finding, deciding, reading again, and keeping all of it when texts change.

A proof is a row a chapter: book_id, ch_idx, title, base_hash (of the text it was made from),
status, proofed, applied, heavy and findings, an array of FINDING in a lasting order; a
finding's index is its name.  Chapters are (book_id, ch_idx, title, text), pages (book_id,
page_ord, page_id, printed_number, text, image).  A proofed text is always made anew from the
chapter and all findings that aren't rejected, so no edit is ever made twice.  Operators read
their proofs several times: give them a stored table (sources.versions, sources.shared.kept).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.functions import pytext
from leafmill.functions.replies import model_findings
from leafmill.functions.text import chapter_hash, heavy, squash, strip
from leafmill.operators import proof
from leafmill.operators.resolve import first_containing
from leafmill.sources.shared import kept, pieces

KEY = ["book_id", "ch_idx"]
FINDING = (
    "struct<source:string,type:string,severity:string,quote:string,replacement:string,note:string,apply_all:boolean,reference:boolean,"
    "user_edit:boolean,rejected:boolean,version:int,applied:boolean,skip_reason:string,page:string,printed_number:bigint>"
)
#: Findings of a lint, and of a reply, that are kept; titles of chapters whose facts a model can't know.
CAP = 40
REFERENCE_TITLES = ("index", "notes", "bibliography", "contents")


def _finding(source: str, type_: Column, severity: Column, quote: Column, replacement: Column, note: Column, apply_all: bool = False, reference: Column | None = None) -> Column:
    no, none = F.lit(False), F.lit(None)
    values = (F.lit(source), type_, severity, quote, replacement, note, F.lit(apply_all), no if reference is None else reference, no, no, F.lit(0), no, none, none, none)
    return F.struct(*values).cast(FINDING)


def lint(text: Column) -> Column:
    """Findings that need no model, in order: placeholders, damaged words, doubled words, repeated paragraphs."""
    text = F.coalesce(text, F.lit(""))
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(quotes: Column, type_: str, severity: str, note: Callable[[Column], Column]) -> Column:
        return F.transform(quotes, lambda q: _finding("lint", F.lit(type_), F.lit(severity), F.substring(q, 1, 120), F.lit(None), note(q)))

    says = lambda note: lambda q: F.lit(note)
    bad = F.array_sort(F.array_distinct(every("(?U)\\S*�\\S*")))
    more = F.when(F.size(bad) > 8, F.concat(F.lit("and "), (F.size(bad) - 8).cast("string"), F.lit(" more damaged words")))
    long = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > 80)
    again = F.transform(F.filter(F.arrays_zip(F.slice(long, 2, F.greatest(F.size(long) - 1, F.lit(0))).alias("b"), long.alias("a")), lambda p: p["a"] == p["b"]), lambda p: p["a"])
    found = F.concat(
        of(every(r"\[\[region-\d+\]\]"), "formatting", "high", says("unresolved figure")),
        of(F.slice(bad, 1, 8), "ocr", "medium", says("damaged characters")),
        of(F.slice(bad, 9, 1), "ocr", "medium", lambda q: more),
        of(every(r"(?iU)\b(\w{3,})\s+\1\b"), "ocr", "low", says("doubled word")),
        of(again, "continuity", "high", says("paragraph twice in a row")),
    )
    return F.slice(found, 1, CAP)


def is_reference(title: Column) -> Column:
    return F.coalesce(F.lower(strip(title)).isin(*REFERENCE_TITLES), F.lit(False))


def findings(chapters: DataFrame, replies: DataFrame, names: bool = True) -> DataFrame:
    """book_id, ch_idx, findings: a chapter's own, then its rare names, then the reply's, each capped.

    Reference chapters get no names, and a reply's findings on them are only suggestions.  A
    chapter without reply has none of that kind; one of several replies is the least.
    """
    said = replies.groupBy(*KEY).agg(F.min("reply").alias("reply"))
    rows = chapters.select(*KEY, "title", "text").join(said, KEY, "left")
    parts = [lint(F.col("text"))]
    if names:
        rare = proof.name_variants(chapters.where(~is_reference(F.col("title"))))
        note = F.concat(F.lit("mostly spelled "), F.col("replacement"))
        each = _finding("names", F.lit("spelling"), F.lit("medium"), F.col("quote"), F.col("replacement"), note, apply_all=True)
        rare = rare.groupBy(*KEY).agg(F.array_sort(F.collect_list(each)).alias("names"))  # ten a chapter at most
        rows = rows.join(rare, KEY, "left")
        parts.append(F.coalesce("names", F.array().cast(f"array<{FINDING}>")))
    reference = is_reference(F.col("title"))
    parts.append(F.transform(F.slice(model_findings(F.col("reply")), 1, CAP), lambda f: _finding("model", f["type"], f["severity"], f["quote"], f["replacement"], f["note"], reference=reference)))
    return rows.select(*KEY, F.concat(*parts).alias("findings"))


def _edited(text: str, findings: list[dict]) -> tuple[str, list[dict]]:
    open_ = [f for f in findings if not f["rejected"]]
    proofed, done = pytext.apply_edits(text, open_)
    results = {id(f): r for f, r in zip(open_, done)}
    return proofed, [f | dict(zip(("applied", "skip_reason"), results.get(id(f), (False, None)))) for f in findings]


def _edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        pairs = zip(batch.column("text").to_pylist(), batch.column("findings").to_pylist())
        proofed, findings = [], []
        for text, listed in pairs:
            new, marked = _edited(text or "", listed or [])
            proofed.append(new)
            findings.append(marked)
        columns = dict(zip(batch.schema.names, batch.columns))
        columns |= {"findings": pa.array(findings, batch.schema.field("findings").type), "proofed": pa.array(proofed, pa.string())}
        yield pa.RecordBatch.from_pydict(columns)


def rebuilt(rows: DataFrame) -> DataFrame:
    """rows with text and findings, with proofed, applied and heavy as those findings make them from that text.

    A chapter's edits change its text one after the other, so a chapter is one row; chapters are spread.
    """
    given = rows.drop("proofed", "applied", "heavy")
    done = given.mapInArrow(_edit_batches, StructType([*given.schema, StructField("proofed", StringType())]))
    count = F.size(F.filter("findings", lambda f: f["applied"]))
    return done.withColumns({"applied": count, "heavy": heavy(F.coalesce("text", F.lit("")), F.col("proofed"))})


def anchored(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows with each finding's page and printed number: the first page of the book that has the quote, else null.

    A place hangs on book and quote alone, so several rows of one chapter each get theirs; of
    several pages with one page_ord the least page_id is named.
    """
    rows = kept(rows)  # read for its quotes, then for itself
    quotes = rows.select(*KEY, F.explode("findings").alias("f")).select(*KEY, F.col("f.quote").alias("text")).distinct()
    found = first_containing(quotes.withColumn("snippet_id", F.struct("ch_idx", "text")), pages, ["book_id"])
    named = found.join(pages.select("book_id", "page_ord", F.col("page_id").cast("string").alias("page_id"), F.col("printed_number").cast("bigint").alias("printed_number")), ["book_id", "page_ord"])
    each = named.groupBy("book_id", "snippet_id").agg(F.min(F.struct("page_id", "printed_number")).alias("place")).select("book_id", "snippet_id.*", "place")
    placed = each.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("text", "place"))).alias("__places"))
    at = lambda f: F.when(f["quote"].isNotNull(), F.try_element_at("__places", f["quote"]))
    moved = F.transform("findings", lambda f: f.withField("page", at(f)["page_id"]).withField("printed_number", at(f)["printed_number"]))
    return rows.join(placed, KEY, "left").withColumn("findings", moved).drop("__places")


PROOF = [*KEY, "title", "base_hash", "status", "proofed", "applied", "heavy", "findings"]


def proofread(chapters: DataFrame, pages: DataFrame, replies: DataFrame, names: bool = True) -> DataFrame:
    """A proof of each chapter, for review: findings, the safe ones applied, each with its page."""
    rows = chapters.select(*KEY, "title", "text").join(findings(chapters, replies, names), KEY)
    return anchored(rebuilt(rows), pages).select(*_with(base_hash=_hash(), status=F.lit("review")))


def _hash() -> Column:
    return chapter_hash(F.coalesce("text", F.lit("")))


def _with(**changed: Column) -> list[Column]:
    return [changed[c].alias(c) if c in changed else F.col(c) for c in PROOF]


_STATE = "struct<rejected:boolean,replacement:string,user_edit:boolean,apply_all:boolean,version:int,outcomes:array<struct<seq:bigint,outcome:string>>>"


def _changed(finding: Column, changes: Column) -> Column:
    """A finding's state after the changes in turn, each compared with the version it was made for."""

    def step(s: Column, c: Column) -> Column:
        own = F.coalesce(c["set_replacement"], F.lit(False))
        rejected = ~c["enabled"]
        replacement = F.when(own, F.coalesce(c["replacement"], F.lit(""))).otherwise(s["replacement"])
        user, every = s["user_edit"] | own, F.when(c["apply_all"], True).when(rejected, False).otherwise(s["apply_all"])
        same = (rejected == s["rejected"]) & replacement.eqNullSafe(s["replacement"]) & (user == s["user_edit"]) & (every == s["apply_all"])
        fits = F.coalesce(c["version"] == s["version"], F.lit(True))
        outcome = F.when(same, "repeated").when(fits, "applied").otherwise("conflict")
        taken = ~same & fits
        new = (F.when(taken, a).otherwise(s[n]) for a, n in ((rejected, "rejected"), (replacement, "replacement"), (user, "user_edit"), (every, "apply_all"), (s["version"] + 1, "version")))
        return F.struct(*new, F.concat(s["outcomes"], F.array(F.struct(c["seq"].alias("seq"), outcome.alias("outcome"))))).cast(_STATE)

    start = F.struct(*(finding[n] for n in ("rejected", "replacement", "user_edit", "apply_all", "version")), F.array()).cast(_STATE)
    return F.aggregate(changes, start, step)


def decide(proofs: DataFrame, chapters: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proofs, outcomes) after changes(book_id, ch_idx, f_idx, seq, version, enabled, apply_all, set_replacement, replacement).

    A change rejects or enables a finding, may promote it to every occurrence, and may set a
    replacement of the user's own.  It is compared with the finding's version, the number of
    changes it has taken: of two made for the same version the first by seq is applied and the
    other is a conflict; one that asks for what is so already is repeated and changes nothing;
    a null version fits any.  Proofs whose chapter has changed take none (stale).  outcomes has
    a row for each change: book_id, ch_idx, f_idx, seq, outcome, with not_proofed, no_chapter
    and no_finding for what isn't there.  Proofs without an applied change stay as they are.
    """
    asked = changes.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "f_idx", "version", "enabled", "apply_all", "set_replacement", "replacement"))).alias("__changes"))
    texts = chapters.select(*KEY, "text", F.lit(True).alias("__there"))
    rows = proofs.withColumn("__proofed", F.lit(True)).join(asked, KEY, "full").join(texts, KEY, "left")
    why = F.when(F.col("__proofed").isNull(), "not_proofed").when(F.col("__there").isNull(), "no_chapter").when(_hash() != F.col("base_hash"), "stale")
    mine = lambda i: F.filter(F.coalesce("__changes", F.array().cast(asked.schema["__changes"].dataType)), lambda c: (c["f_idx"] == i) & F.col("__why").isNull())
    rows = rows.withColumn("__why", why).withColumn("__states", F.transform("findings", lambda f, i: _changed(f, mine(i))))
    said = F.flatten(F.transform("__states", lambda s: s["outcomes"]))
    each = rows.where("__changes is not null").select(*KEY, "__why", said.alias("__said"), F.explode("__changes").alias("c"))
    outcome = F.coalesce("__why", F.try_element_at(F.filter("__said", lambda o: o["seq"] == F.col("c.seq")), F.lit(1))["outcome"], F.lit("no_finding"))
    outcomes = each.select(*KEY, F.col("c.f_idx").alias("f_idx"), F.col("c.seq").alias("seq"), outcome.alias("outcome"))
    touched = F.coalesce(F.exists(F.flatten(F.transform("__states", lambda s: s["outcomes"])), lambda o: o["outcome"] == "applied"), F.lit(False))
    rows = rows.where("__proofed").withColumn("__touched", touched)
    named = ("rejected", "replacement", "user_edit", "apply_all", "version")

    def taken(f: Column, s: Column) -> Column:
        for n in named:
            f = f.withField(n, s[n])
        return f

    new = rebuilt(rows.where("__touched").withColumn("findings", F.zip_with("findings", "__states", taken)))
    return rows.where("not __touched").select(*PROOF).unionByName(new.select(*PROOF)), outcomes


def stuck_work(proofs: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, ch_idx, f_idx, quote, page_id, image: the findings that reading their page again may settle."""
    each = proofs.select(*KEY, F.posexplode("findings").alias("f_idx", "f")).select(*KEY, "f_idx", "f.*")
    each = each.where(proof.stuck()).select(*KEY, "f_idx", "quote", F.col("page").alias("page_id"))
    shown = pages.where("image is not null").select("book_id", F.col("page_id").cast("string").alias("page_id"), "image")
    return each.join(shown, ["book_id", "page_id"])


def reread(proofs: DataFrame, chapters: DataFrame, pages: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(proofs, report) after reading the pages of stuck findings again.

    read maps stuck_work to (book_id, ch_idx, f_idx, replacement).  An answer that is null,
    blank, or reads like the quote is refused; others become the replacement, with a note, go
    through the guards like any, and are enabled.  report: book_id, ch_idx, attempted, rescued,
    still_manual.  Stale proofs and such without stuck findings stay as they are.
    """
    rows = proofs.join(chapters.select(*KEY, "text"), KEY, "left").withColumn("__fresh", F.col("base_hash").eqNullSafe(_hash()) & F.col("text").isNotNull())
    work = stuck_work(rows.where("__fresh"), pages)
    answers = read(work).groupBy(*KEY, "f_idx").agg(F.min("replacement").alias("replacement"))
    asked = work.select(*KEY, "f_idx").join(answers, [*KEY, "f_idx"], "left").groupBy(*KEY).agg(F.collect_list(F.struct("f_idx", strip(F.col("replacement")).alias("new"))).alias("__asked"))
    rows = rows.join(asked, KEY, "left")
    answer = lambda i: F.try_element_at(F.filter("__asked", lambda a: a["f_idx"] == i), F.lit(1))["new"]
    good = lambda f, i: F.coalesce((answer(i) != "") & (squash(answer(i)) != squash(f["quote"])), F.lit(False))
    rows = rows.withColumn("__good", F.transform("findings", good))
    note = lambda f: strip(F.concat(F.coalesce(f["note"], F.lit("")), F.lit(" [read again from the page]")))
    taken = lambda f, i: F.when(F.get("__good", i), f.withField("replacement", answer(i)).withField("note", note(f)).withField("rejected", F.lit(False)).withField("version", f["version"] + 1)).otherwise(f)
    new = rebuilt(rows.where("__asked is not null").withColumn("findings", F.transform("findings", taken)))
    rescued = F.size(F.filter(F.zip_with("findings", "__good", lambda f, g: f["applied"] & g), lambda x: x))
    report = new.select(*KEY, F.size("__asked").alias("attempted"), rescued.alias("rescued")).withColumn("still_manual", F.col("attempted") - F.col("rescued"))
    return rows.where("__asked is null").select(*PROOF).unionByName(new.select(*PROOF)), report


def carried(proofs: DataFrame, chapters: DataFrame) -> DataFrame:
    """proofs at the chapters that now hold their text: a proof follows its hash to another index.

    That is if its own chapter no longer has the hash, just one chapter of the book has it, and
    no proof is at home there.  Several proofs of one text, or several chapters with it, leave all where they are.
    """
    now = chapters.select(*KEY, _hash().alias("base_hash"))
    home = proofs.join(now, [*KEY, "base_hash"], "left_semi").select(*KEY)
    lost = proofs.join(now, [*KEY, "base_hash"], "left_anti").groupBy("book_id", "base_hash").agg(F.count("*").alias("n"), F.min("ch_idx").alias("ch_idx")).where("n = 1")
    free = now.groupBy("book_id", "base_hash").agg(F.count("*").alias("n"), F.min("ch_idx").alias("__to")).where("n = 1").drop("n")
    moves = lost.drop("n").join(free, ["book_id", "base_hash"]).where(F.col("ch_idx") != F.col("__to"))
    taken = home.select("book_id", F.col("ch_idx").alias("__to"))
    moves = moves.join(taken, ["book_id", "__to"], "left_anti").select(*KEY, "__to")
    rows = proofs.join(moves, KEY, "left").withColumn("__own", F.col("__to").isNull())
    # A proof that stays gives way to one whose text has come to its place.
    come = moves.select("book_id", F.col("__to").alias("ch_idx"), F.lit(True).alias("__come"))
    stays = rows.where("__own").join(come, KEY, "left_anti")
    return stays.unionByName(rows.where("not __own").withColumn("ch_idx", F.col("__to"))).select(*PROOF)


def refresh(proofs: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """proofs, the stale ones made anew from the chapters as they are, without asking a model.

    Findings, decisions and status stay; quotes are placed in the new text and on its pages, and
    what is no longer there, or there twice, is not applied and says so.  Proofs of chapters that
    are gone and those that aren't stale stay as they are, so doing it twice changes nothing.
    """
    now = chapters.select(*KEY, F.col("title").alias("__title"), "text")
    rows = carried(proofs, chapters).join(now, KEY, "left")
    stale = F.col("text").isNotNull() & (_hash() != F.col("base_hash"))
    new = anchored(rebuilt(rows.where(stale)), pages)
    return rows.where(~F.coalesce(stale, F.lit(False))).select(*PROOF).unionByName(new.select(*_with(title=F.col("__title"), base_hash=_hash())))

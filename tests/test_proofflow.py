"""The proof workflow against plain versions, and two writers of one table."""

import hashlib
import json
import threading

import duckdb
import pytest
from leafmill.functions import pytext
from leafmill.operators import proofflow as pf
from leafmill.plans import proofing
from leafmill.sources import versions
from leafmill.sources.shared import kept
from oracle import TABLES, assert_matches


@pytest.mark.parametrize("name", sorted(proofing.ORACLES))
def test_same_as_sql(spark, data, name):
    assert assert_matches(spark, data, proofing.QUERIES[name], proofing.ORACLES[name])


CHAPTER = "book_id string, ch_idx long, title string, text string"
LONG = "A paragraph that is long enough to be looked at, with more than eighty characters in it, twice over."
TEXT = f"Mather rode out. Mather rode home. Mather slept. Mather woke. Mater sang of the the river.\n\n{LONG}\n\n{LONG}\n\nSee [[region-3]] and b�d words.\n\nA garbelled sentence stands here alone, you see."


def book(spark, text=TEXT):
    rows = [("b", 0, "One", text), ("b", 1, " Index ", "Mather, 7\ngarbelled sentence, 9"), ("b", 2, None, None), ("c", 0, "One", "Mater alone, nothing else.")]
    return spark.createDataFrame(rows, CHAPTER)


def pages(spark, text=TEXT):
    rows = [("b", 5, "p5", 12, text[:95], "i5"), ("b", 6, "p6", 13, text[95:], "i6"), ("b", 7, "p7", None, text[95:], None), ("c", 1, "q1", 1, TEXT, "x")]
    return spark.createDataFrame(rows, "book_id string, page_ord long, page_id string, printed_number long, text string, image string")


def replies(spark):
    good = {"findings": [{"type": "ocr", "severity": "high", "quote": "garbelled sentence stands", "replacement": "garbled sentence stands"}, {"quote": "", "replacement": "x"}, {"quote": "sang of the the river", "note": "odd"}, 3, {"quote": "rode"}]}
    rows = [("b", 0, "```json\n" + json.dumps(good) + "\n```"), ("b", 1, '{"findings": [{"quote": "garbelled sentence", "replacement": "garbled sentence"}, {"quo'), ("b", 2, "no"), ("zz", 9, "{}")]
    return spark.createDataFrame(rows, "book_id string, ch_idx long, reply string")


def test_proofread(spark):
    out = {(r.book_id, r.ch_idx): r for r in pf.proofread(book(spark), pages(spark), replies(spark)).collect()}
    assert len(out) == 4
    first = out["b", 0]
    found = [(f.source, f.type, f.quote, f.applied, f.skip_reason, f.page) for f in first.findings]
    assert found == [
        ("lint", "formatting", "[[region-3]]", False, None, None),
        ("lint", "ocr", "b�d", False, None, None),
        ("lint", "ocr", "the the", False, None, None),
        ("lint", "continuity", LONG, False, None, "p6"),
        ("names", "spelling", "Mater", True, None, None),
        ("model", "ocr", "garbelled sentence stands", True, None, "p6"),
        ("model", "other", "sang of the the river", False, None, "p5"),
        ("model", "other", "rode", False, None, None),
    ]
    assert first.proofed == TEXT.replace("Mater", "Mather").replace("garbelled", "garbled") and first.applied == 2 and not first.heavy
    assert first.base_hash == hashlib.sha1(TEXT.strip().encode()).hexdigest()[:16] and first.status == "review"
    index = out["b", 1]
    assert [(f.quote, f.reference, f.skip_reason) for f in index.findings] == [("garbelled sentence", True, "reference")] and index.applied == 0
    assert out["b", 2].findings == [] and out["b", 2].proofed == "" and out["c", 0].findings == []
    assert pf.proofread(book(spark).limit(0), pages(spark), replies(spark)).count() == 0


def test_findings_are_capped_and_in_order(spark):
    text = " ".join(f"[[region-{k}]]" for k in range(60)) + " ".join(f" x{k}�" for k in range(12))
    row = spark.createDataFrame([("b", 0, "T", text), ("b", 1, "T", text.replace("[[region", "[["))], CHAPTER)
    said = spark.createDataFrame([("b", k, json.dumps({"findings": [{"quote": f"q{i}"} for i in range(50)]})) for k in (0, 1)], "book_id string, ch_idx long, reply string")
    out = {r.ch_idx: r.findings for r in pf.findings(row, said).collect()}
    assert [f.quote for f in out[0]] == [f"[[region-{k}]]" for k in range(40)] + [f"q{k}" for k in range(40)]
    damaged = [f for f in out[1] if f.source == "lint"]
    assert len(damaged) == 9 and [f.note for f in damaged[8:]] == ["and 4 more damaged words"] and damaged[0].quote == sorted(f"x{k}�" for k in range(12))[0]


CHANGE = "book_id string, ch_idx long, f_idx int, seq long, version int, enabled boolean, apply_all boolean, set_replacement boolean, replacement string"


def plain(proof, chapter, changes):
    """One chapter's decisions and text, by the docstring's words."""
    findings, outcomes = [dict(f) for f in proof], {}
    for f_idx, seq, version, enabled, every, own, new in sorted(changes, key=lambda c: c[1]):
        if not 0 <= f_idx < len(findings):
            outcomes[seq] = "no_finding"
            continue
        f = findings[f_idx]
        want = {"rejected": not enabled, "apply_all": True if every else (False if not enabled else f["apply_all"])}
        if own:
            want |= {"replacement": new or "", "user_edit": True}
        if all(f[k] == v for k, v in want.items()):
            outcomes[seq] = "repeated"
        elif version is None or version == f["version"]:
            f.update(want, version=f["version"] + 1)
            outcomes[seq] = "applied"
        else:
            outcomes[seq] = "conflict"
    text, results = pytext.apply_edits(chapter, [f for f in findings if not f["rejected"]])
    return findings, outcomes, text, sum(a for a, _ in results)


def test_decisions(spark):
    chapters = book(spark)
    proofs = kept(pf.proofread(chapters, pages(spark), replies(spark)))
    asked = [
        (5, 1, 0, False, False, False, None), (5, 2, 0, True, True, False, None), (5, 3, 1, False, False, False, None), (5, 4, 1, True, False, False, None),
        (6, 5, None, True, False, True, "sang by the river"), (6, 6, 0, True, False, True, "other"), (6, 7, 1, True, False, True, "sang by the river"),
        (7, 8, 0, True, True, True, None), (99, 9, 0, True, False, False, None), (-1, 10, 0, True, False, False, None), (2, 11, 0, True, False, True, "the"),
    ]
    others = [("b", 7, 0, 1, 0, True, False, False, None), ("c", 0, 0, 1, 0, True, False, False, None)]
    changes = spark.createDataFrame([("b", 0, *a) for a in asked] + others, CHANGE)
    old = {(r.book_id, r.ch_idx): r for r in proofs.collect()}
    new, outcomes = pf.decide(proofs, chapters, changes)
    new = {(r.book_id, r.ch_idx): r for r in new.collect()}
    findings, said, text, applied = plain([f.asDict() for f in old["b", 0].findings], TEXT, asked)
    got = {(r.book_id, r.ch_idx, r.seq): r.outcome for r in outcomes.collect()}
    assert got == {("b", 0, k): v for k, v in said.items()} | {("b", 7, 1): "not_proofed", ("c", 0, 1): "no_finding"}
    assert set(said.values()) == {"applied", "conflict", "repeated", "no_finding"}
    names = ("rejected", "replacement", "user_edit", "apply_all", "version")
    assert [tuple(f[n] for n in names) for f in new["b", 0].findings] == [tuple(f[n] for n in names) for f in findings]
    assert (new["b", 0].proofed, new["b", 0].applied) == (text, applied) and "rode" not in text
    assert {k: v for k, v in new.items() if k != ("b", 0)} == {k: v for k, v in old.items() if k != ("b", 0)}
    stale, outcomes = pf.decide(proofs, book(spark, TEXT + " More."), changes)
    assert {r.outcome for r in outcomes.where("book_id = 'b' and ch_idx = 0").collect()} == {"stale"}
    assert sorted(map(str, stale.collect())) == sorted(map(str, old.values()))


def test_two_writers_lose_nothing(spark, tmp_path):
    path, chapters = str(tmp_path / "proofs"), book(spark)
    versions.commit(pf.proofread(chapters, pages(spark), replies(spark)), path, -1)
    base = versions.latest(spark, path)
    mine = [spark.createDataFrame([("b", 0, f, f, 0, False, False, False, None)], CHANGE) for f in (5, 6, 7)]
    took = pf.decide(versions.read(spark, path, base), chapters, mine[0])[0]
    assert versions.commit(took, path, base) == base + 1
    late = pf.decide(versions.read(spark, path, base), chapters, mine[1])[0]
    with pytest.raises(versions.Conflict):
        versions.commit(late, path, base)
    writers = [threading.Thread(target=versions.update, args=(spark, path, lambda t, c=c: pf.decide(t, chapters, c)[0])) for c in mine[1:]]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    now = versions.read(spark, path).where("book_id = 'b' and ch_idx = 0").first()
    assert [k for k, f in enumerate(now.findings) if f.rejected] == [5, 6, 7] and versions.latest(spark, path) == base + 3
    assert versions.read(spark, path, base).where("book_id = 'b' and ch_idx = 0").first().findings[5].applied  # what was read stays


def test_reading_again(spark):
    chapters, shown = book(spark), pages(spark)
    proofs = kept(pf.proofread(chapters, shown, replies(spark)))
    work = {(r.ch_idx, r.f_idx): (r.page_id, r.image) for r in pf.stuck_work(proofs, shown).collect()}
    assert work == {(0, 3): ("p6", "i6"), (0, 6): ("p5", "i5")}
    said = lambda w: w.selectExpr("book_id", "ch_idx", "f_idx", "if(f_idx = 6, ' sang of the river ', upper(quote)) as replacement")
    new, report = pf.reread(proofs, chapters, shown, said)
    assert [tuple(r) for r in report.collect()] == [("b", 0, 2, 1, 1)]
    row = new.where("book_id = 'b' and ch_idx = 0").first()
    assert row.findings[6].applied and row.findings[6].note.endswith("[read again from the page]") and "sang of the river" in row.proofed
    assert row.findings[3].replacement is None and new.count() == 4
    nothing = lambda w: w.selectExpr("book_id", "ch_idx", "f_idx", "cast(null as string) as replacement")
    assert [tuple(r) for r in pf.reread(proofs, chapters, shown, nothing)[1].collect()] == [("b", 0, 2, 0, 2)]


def test_refresh_keeps_decisions_and_does_nothing_twice(spark):
    proofs = kept(pf.proofread(book(spark), pages(spark), replies(spark)))
    proofs, _ = pf.decide(proofs, book(spark), spark.createDataFrame([("b", 0, 5, 1, 0, False, False, False, None), ("b", 0, 6, 2, 0, True, False, True, "sang by the river")], CHANGE))
    proofs = kept(proofs)
    text = "New first page.\n\n" + TEXT.replace("rode", "walked")
    later = spark.createDataFrame([("b", 3, "One, again", text), ("b", 0, "Moved in", "Mather, 7\ngarbelled sentence, 9"), ("c", 0, "One", "Mater alone, nothing else.")], CHAPTER)
    seen = pages(spark, text)
    out = kept(pf.refresh(proofs, later, seen))
    rows = {(r.book_id, r.ch_idx): r for r in out.collect()}
    # The index's proof follows its text to another chapter, and the proof that stood there gives way.
    assert set(rows) == {("b", 0), ("b", 2), ("c", 0)} and rows["b", 0].title == " Index "
    again = pf.refresh(out, later, seen)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    stayed = spark.createDataFrame([("b", 0, "One, again", text)], CHAPTER)
    new = pf.refresh(proofs, stayed, seen).where("book_id = 'b' and ch_idx = 0").first()
    assert new.title == "One, again" and new.findings[5].rejected and new.findings[6].user_edit and new.findings[6].version == 1
    assert new.findings[7].skip_reason is None and "sang by the river" in new.proofed and "garbelled" in new.proofed
    assert new.base_hash == hashlib.sha1(text.strip().encode()).hexdigest()[:16] and new.findings[5].page == "p6"


def test_chapters_and_pages_that_share_a_place(spark):
    proofs = kept(pf.proofread(book(spark), pages(spark), replies(spark)))
    text = "New first page.\n\n" + TEXT
    later = spark.createDataFrame([("b", 0, "One", text), ("b", 0, "Other", "Other. " + TEXT)], CHAPTER)
    seen = pages(spark, text).unionByName(pages(spark, text).selectExpr("book_id", "page_ord", "concat(page_id, 'x') as page_id", "printed_number", "text", "image"))
    out = pf.refresh(proofs, later, seen).where("book_id = 'b' and ch_idx = 0").orderBy("title").collect()
    assert [r.title for r in out] == ["One", "Other"] and out[0].proofed != out[1].proofed
    for r in out:  # the second quote is cut by the end of a page
        assert [(f.quote, f.page) for f in r.findings[5:7]] == [("garbelled sentence stands", "p6"), ("sang of the the river", None)]


def test_refresh_where_moved_chapters_meet_others(spark, data, tmp_path):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{data}/{t}.parquet")
    (tmp_path / "documents.parquet").unlink()
    docs = f"(from '{data}/documents.parquet' where doc_id < 60)"
    more = f"select * replace (doc_id + 1000000 as doc_id, if(doc_id % 4 = 1, 'Copy. ' || text, text) as text) from {docs}"
    duckdb.sql(f"copy (from {docs} union all {more}) to '{tmp_path}/documents.parquet'")
    assert_matches(spark, str(tmp_path), proofing.QUERIES["refresh_proofs"], proofing.ORACLES["refresh_proofs"])


def test_words_split_anywhere_match():
    assert pytext.quote_pattern("in 1990 he said").search("back in 19- 90 he sa–\nid")
    assert not pytext.quote_pattern("in 1990 he").search("in 19 90 he")
    assert pytext.quote_pattern("it's \"so\"...").search("it’s “so”...")

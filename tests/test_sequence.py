from itertools import groupby

import pytest
from leafmill.operators import sequence as seq
from pyspark.sql import functions as F

PAGE = (
    "book_id long, page_ord long, video long, frame_no long, printed_number long, number_manual boolean, confidence string, composite double, "
    "status string, patched_source string, dedupe_exempt boolean, manual_duplicate boolean, pinned string, role string, source string"
)
BLANK = dict(
    book_id=0, video=0, number_manual=False, confidence="high", composite=0.5, status="ok", patched_source=None, dedupe_exempt=False,
    manual_duplicate=False, pinned=None, role=None, source=None, printed_number=None,
)


def pages(spark, rows):
    names = [f.split()[0] for f in PAGE.split(", ")]
    full = [BLANK | {"page_ord": i, "frame_no": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], PAGE)


def numbers(*values):
    return [{"printed_number": v} for v in values]


def frames(spark, motions, flatness=0.6):
    rows = [(0, i + 1, float(m), flatness) for i, m in enumerate(motions)]
    return spark.createDataFrame(rows, "video long, i long, motion double, flatness double")


def segments(spark, motions):
    out = seq.segment_pages(frames(spark, motions), turn_min=4, factor=2.5)
    return [r.n_frames for r in out.orderBy("page").collect()]


@pytest.mark.parametrize(
    "motions, expected",
    [
        ([0] + [2] * 7 + [20] * 6 + [2] * 8, [8, 8]),
        ([0] + [2] * 7 + [20] * 2 + [2] * 8, [16]),
        ([0] + [2] * 9 + [20] * 5 + [4.5] * 2 + [20] * 5 + [2] * 10, [10, 10]),
        ([0] + [2] * 9 + [20] * 5 + [2] * 3 + [20] * 5 + [2] * 10, [10, 3, 10]),
        ([3], []),
    ],
)
def test_segments(spark, motions, expected):
    assert segments(spark, motions) == expected


def statuses(df):
    return [r.status for r in df.orderBy("page_ord").collect()]


def test_dedupe_keeps_the_best(spark):
    rows = [
        {"printed_number": 5, "confidence": "low", "composite": 0.3},
        {"printed_number": 5, "composite": 0.6},
        {"printed_number": 6},
        {},
        {},
    ]
    once = seq.dedupe_by_number(pages(spark, rows))
    assert statuses(once) == ["duplicate", "ok", "ok", "ok", "ok"]
    assert statuses(seq.dedupe_by_number(once)) == statuses(once)


def test_dedupe_photo_wins_and_pdf_is_exempt(spark):
    rows = [{"printed_number": 24, "composite": 0.9}, {"printed_number": 24, "composite": 0.0, "patched_source": "x"}]
    assert statuses(seq.dedupe_by_number(pages(spark, rows))) == ["duplicate", "ok"]
    rows = [{"printed_number": n, "source": "pdf"} for n in (1, 2, 1, 2, 1)]
    assert statuses(seq.dedupe_by_number(pages(spark, rows))) == ["ok"] * 5


def test_ties_keep_the_first(spark):
    assert statuses(seq.dedupe_by_number(pages(spark, numbers(3, 3)))) == ["ok", "duplicate"]


def values(df):
    return [r.printed_number for r in df.orderBy("page_ord").collect()]


def test_sanitize_then_infer(spark):
    fixed = seq.sanitize_numbers(pages(spark, numbers(200, 202, 204, 266, 208, 210)))
    assert values(fixed) == [200, 202, 204, None, 208, 210]
    assert values(seq.infer_from_video_order(fixed)) == [200, 202, 204, 206, 208, 210]


def test_sanitize_descending_and_manual(spark):
    assert values(seq.sanitize_numbers(pages(spark, numbers(50, 48, 12, 44, 42)))) == [50, 48, None, 44, 42]
    rows = numbers(10, 99, 12, 14, 16)
    rows[1]["number_manual"] = True
    assert values(seq.sanitize_numbers(pages(spark, rows)))[1] == 99
    assert values(seq.sanitize_numbers(pages(spark, numbers(9, 1)))) == [9, 1]


def test_kept_numbers_are_monotone():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.integers(-5, 30), max_size=12))
    def check(values):
        kept = [values[i] for i in sorted(seq.monotone_keep(values, [1] * len(values)))] if values else []
        assert kept == sorted(kept) or kept == sorted(kept, reverse=True)
        if values:
            longest = max(_longest(values), _longest([-v for v in values]))
            assert len(kept) == longest

    check()


def _longest(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] <= v), default=0))
    return max(best)


def test_infer_descending(spark):
    assert values(seq.infer_from_video_order(pages(spark, numbers(121, 119, 117, None, 113, 111)))) == [121, 119, 117, 115, 113, 111]
    assert values(seq.infer_from_video_order(pages(spark, numbers(1, None, 9)))) == [1, None, 9]


def test_crowded_gap_is_a_conflict(spark):
    out = seq.infer_missing(pages(spark, numbers(5, None, None, 6)).withColumn("number_inferred", seq.F.lit(False)))
    assert statuses(out) == ["ok", "suspect", "suspect", "ok"]


def test_missing_and_ranges(spark):
    base = pages(spark, numbers(-2, -1, 1, 2, 5))
    lost = [r.n for r in seq.missing_numbers(base).orderBy("n").collect()]
    assert lost == [3, 4]
    given = spark.createDataFrame([(0, n) for n in (6, 7, 14, 22, 23, 24)], "book_id long, n long")
    assert seq.format_ranges(given).first().ranges == "6-7, 14, 22-24"
    assert seq.format_ranges(given.limit(0)).count() == 0


def test_gap_marker(spark):
    rows = seq.gap_markers(pages(spark, numbers(11, 14, 15))).collect()
    assert [(r.before_ord, r.first_missing, r.last_missing) for r in rows] == [(1, 12, 13)]


def order_of(df):
    return [r.page_ord for r in df.orderBy("new_ord").collect()]


def test_reorder(spark):
    rows = [{"printed_number": 3}, {"frame_no": 1}, {"printed_number": 1}, {"printed_number": 2}, {"pinned": "start", "role": "cover"}]
    out = order_of(seq.reorder(pages(spark, rows)))
    assert out[0] == 4 and out[1:3] == [2, 3]
    assert order_of(seq.reorder(pages(spark, [{}] * 5))) == [0, 1, 2, 3, 4]


def test_reconcile_repeats_itself(spark):
    rows = numbers(200, 202, 204, 266, 208, 210) + numbers(204, None, 208)
    once = seq.reconcile(pages(spark, rows))
    again = seq.reconcile(once.select(*[f.split()[0] for f in PAGE.split(", ")]))
    assert order_of(once) and [k for k, _ in groupby(values(once))] == [k for k, _ in groupby(values(again))]


def test_composites_equal_to_twelve_places_are_a_tie(spark):
    rows = [(1, 5, 1.0, 0.6), (1, 4, 1.0, 0.6 - 1e-15), (1, 3, 1.0, 0.5), (2, 8, 1.0, 0.3), (2, 7, 1.0, 0.3 - 1e-9)]
    scores = spark.createDataFrame([(c, f, s, x, 0.0, 0.0) for c, f, s, x in rows], "cluster long, frame long, sharpness double, flatness double, occlusion double, motion double")
    got = {r.cluster: (r.canonical, r.fallback) for r in seq.best_frames(scores).collect()}
    assert got == {1: (4, 5), 2: (8, 7)}


def test_percentiles_are_exact_and_of_no_single_task(spark):
    rows = spark.range(1, 5001, 1, 4).selectExpr("if(id % 7 = 0, null, pmod(id * 7919, 1009) / 8.0D) as a", "cast(id % 3 as double) as b", "cast(null as double) as none")
    want = rows.selectExpr("percentile(a, 0.95) as a", "median(b) as b", "percentile(a, 0.1) as c").first()
    made = seq.percentiles(rows, a=(F.col("a"), 0.95), b=(F.col("b"), 0.5), c=(F.col("a"), 0.1), none=(F.col("none"), 0.5))
    got = made.first()
    assert got.none is None and all(abs(got[k] - want[k]) < 1e-9 for k in "abc")
    for scores in (rows.limit(0), rows):
        norms = seq.score_norms(scores.selectExpr("a as sharpness", "b as motion"))
        assert "percentile" not in norms._jdf.queryExecution().executedPlan().toString() and norms.count() == 1
    assert tuple(seq.score_norms(rows.limit(0).selectExpr("a as sharpness", "b as motion")).first()) == (0.0, 1.0)


def test_low_tail_needs_no_percentile_in_one_task(spark):
    pages = spark.range(1, 101).selectExpr("id as cluster", "if(id <= 2, 0.1D, id / 10.0D) as composite")
    low = seq.low_tail(pages)
    assert "percentile" not in low._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.cluster for r in low.collect()) == [1, 2, 3, 4, 5]


def test_best_frames_are_dealt_by_their_number(spark, monkeypatch):
    """More frames mean more tasks, not more for each of the session's four."""
    monkeypatch.setattr("leafmill.sources.shared.TASK_ROWS", 100)
    scores = spark.range(2000).selectExpr("id div 3 as cluster", "id as frame", "id % 17 + 1.0D as sharpness", "0.5D as flatness", "0.0D as occlusion", "0.0D as motion")
    best = seq.best_frames(scores)
    assert best.groupBy(F.spark_partition_id()).count().count() > 12 and best.count() == 667
    want = {k: max(range(3 * k, min(3 * k + 3, 2000)), key=lambda i: (min((i % 17 + 1) / 17, 1), -i)) for k in range(667)}
    assert {r.cluster: r.canonical for r in best.collect()} == want


@pytest.mark.parametrize("bits", [1, 3, 40])
def test_books_are_gone_through_in_blocks(spark, monkeypatch, bits):
    """Blocks of any size give the same rows, and no task has a whole book."""
    import random

    rng, rows = random.Random(7), []
    for k in range(240):
        rows.append({
            "book_id": rng.choice([0, 0, 0, 1, None]), "page_ord": k * 3 - 200, "video": k // 20, "printed_number": rng.choice([None, None, k // 2, k // 2, rng.randint(1, 9)]),
            "pinned": rng.choice([None] * 8 + ["start", "end"]), "status": rng.choice(["ok"] * 5 + ["deleted"]),
        })
    table = pages(spark, rows).withColumn("number_inferred", F.lit(False))
    book = [r for r in rows if r["book_id"] == 0]
    has = [i for i, r in enumerate(book) if r["printed_number"] is not None]
    near = lambda i: None if i is None else (book[i]["printed_number"], i + 1)
    want = {r["page_ord"]: (i + 1, near(max((j for j in has if j < i), default=None)), near(min((j for j in has if j > i), default=None))) for i, r in enumerate(book)}
    monkeypatch.setattr(seq, "BLOCK_BITS", bits)
    found = seq._around(table, ["book_id"], F.col("printed_number"), 8)
    assert {r.page_ord: (r["at"], r.a and tuple(r.a), r.b and tuple(r.b)) for r in found.where("book_id = 0").collect()} == want
    if bits < 40:
        assert found.where("book_id = 0").groupBy(F.spark_partition_id()).count().count() > 1
    order = {(r.book_id, r.page_ord): r.new_ord for r in seq.reorder(table).collect()}
    after = sorted((r.page_ord, r.printed_number, r.status) for r in seq.infer_missing(table).where("printed_number is not null").collect())
    monkeypatch.setattr(seq, "BLOCK_BITS", 50)
    assert order == {(r.book_id, r.page_ord): r.new_ord for r in seq.reorder(table).collect()} and len(order) == len(rows)
    assert after == sorted((r.page_ord, r.printed_number, r.status) for r in seq.infer_missing(table).where("printed_number is not null").collect())
    assert all(sorted(n for (b, _), n in order.items() if b == k) == list(range(1, 1 + sum(r["book_id"] == k for r in rows))) for k in (0, 1, None))


def test_reorder_keeps_pages_without_book_or_place(spark):
    rows = [{"page_ord": None, "printed_number": 4}, {"printed_number": 3}, {"printed_number": 9, "book_id": None}]
    found = seq.reorder(pages(spark, rows)).collect()
    assert sorted((str(r.book_id), r.printed_number, r.new_ord) for r in found) == [("0", 3, 1), ("0", 4, 2), ("None", 9, 1)]


def test_captures_are_placed_without_a_task_for_each_book(spark, data):
    from leafmill.plans import fixtures

    placed = fixtures.captures(spark, data)
    assert placed.where("page_ord is null").count() == 0 and "row_number() windowspecdefinition(_w" not in placed._jdf.queryExecution().executedPlan().toString()
    top = placed.groupBy("book_id").agg(F.count("*").alias("n"), F.max("page_ord").alias("top"), F.count_distinct("page_ord").alias("each")).collect()
    assert top and all(r.n == r.top == r["each"] for r in top)

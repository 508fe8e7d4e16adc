"""Mixing, hard negatives and vector codes, on hostile rows, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from leafmill.llm import codes, mixing, negatives, oracles, queries, vectors
from oracle import assert_matches

NAMES = ["op11_source_mixing", "op12_hard_negatives", "op13_vector_codes"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, data, name):
    assert assert_matches(spark, data, queries.queries()[name], oracles.ORACLES[name])


def targets(sizes, percent=150, cap=2, weights=(3, 1, 2)):
    """By the contract's words: share, stop at the cap, share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, out = sum(sizes.values()) * percent / 100, set(sizes), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


DOCS = "doc_id long, text string, source string, size string, `c0` int, copies string"


def hostile_documents():
    rng = random.Random(5)
    rows = [(k, "w " * rng.choice([0, 1, 3, 10, 40, 300]), rng.choice(["hot", "hot", "hot", "b", "é", "\U0001f600", None, "zz"]), "x", k, "y") for k in range(600)]
    rows += [(7, "a b", "b", None, None, None)] * 3 + [(None, "a b c", "b", None, 1, None)] * 2 + [(601, None, None, None, 1, None), (602, "", "", None, 1, None), (603, "long " * 200000, "zz", None, 1, None), (604, "\x85\xa0 \t\n", "only", "", 1, "")]
    return rows


def test_mixing(spark):
    rows = hostile_documents()
    docs = spark.createDataFrame(rows, DOCS)
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size(r[1])
    want = targets(sizes)
    mixed = lambda d: mixing.mix_copies(d, mixing.blank_separated_words(mixing.F.col("text")), ["doc_id", "source", "copies"])
    got = mixed(docs).toDF("doc_id", "source", "carried", "size", "source_size", "target", "copies").collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=key) == sorted(((r[0], r[2], size(r[1])) for r in rows), key=key)
    for s, n in sizes.items():
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == n and math.isclose(r.target, want[s]) for r in mine)
        rate = want[s] / n if n else 0
        assert all(math.floor(rate) <= r.copies <= min(2, math.floor(rate) + 1) for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - want[s]) <= max(r.size for r in mine) + 1
        assert abs(sum(r.copies for r in mine) - rate * len(mine)) <= 1
    again = mixed(docs.repartition(5)).toDF(*mixed(docs).columns[:2], "carried", *mixed(docs).columns[3:6], "n").collect()
    assert sorted(map(str, (tuple(r) for r in again))) == sorted(map(str, (tuple(r) for r in got)))
    assert mixed(docs.limit(0)).count() == 0


def test_mixture_repeats_whole_rows(spark):
    docs = spark.createDataFrame(hostile_documents(), DOCS)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    taken = mixing.mix_copies(docs, mixing.blank_separated_words(mixing.F.col("text")), ["doc_id"])
    assert out.count() == taken.agg({taken.columns[-1]: "sum"}).first()[0]
    assert {r.c0 for r in out.collect()} <= {r[4] for r in hostile_documents()}


def test_mixing_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    rows = mixing.mix_copies(docs, mixing.blank_separated_words(mixing.F.col("text")), ["doc_id"]).collect()
    assert [(r.target, r.copies) for r in rows] == [(0.0, 0)] * 2


def hostile_vectors():
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((8, 10))
    rows = [(int(k), (centre[k % 8] + 0.4 * rng.standard_normal(10)).tolist(), int(rng.integers(0, 4))) for k in rng.permutation(900)]
    hot = rows[3][1]
    rows += [(k, hot, 1) for k in range(1000, 1300)]  # a third are copies
    rows += [(1400, None, 1), (1500, [], 1), (1600, [float("nan")] * 10, 1), (1700, [None] + [1.0] * 9, 1), (1800, [float("inf")] * 10, 1), (1900, [1.0] * 3, 1)]
    rows += [(2000, [0.0] * 10, 2), (2100, [1e30] * 10, 2), (2200, hot, None), (None, hot, 1), (2300, hot, 77), (5, rows[5][1], 3), (200, rows[9][1], 1), (200, rows[9][1], 1)]
    return rows


def floors(v, factor, width=10):
    top = vectors.largest(width)
    return np.clip(np.floor(np.array(v, np.float64) * factor), -top, top).astype(np.int64)


def sound(v):
    return bool(v) and len(v) == 10 and None not in v and bool(np.isfinite(v).all())


def brute_negatives(rows):
    kept = [(i, floors(v, 256), l) for i, v, l in rows if i is not None and l is not None and sound(v)]
    q = np.array([v for _, v, _ in kept])
    out = []
    for i, v, l in kept:
        if i % 100:
            continue
        score = (q @ v).tolist()
        order = sorted(range(len(kept)), key=lambda k: (-score[k], kept[k][0]))
        for p in [k for k in order if kept[k][2] == l and kept[k][0] != i][:5]:
            near = [k for k in order if kept[k][2] != l and kept[k][0] != i and 30 * score[p] <= 100 * score[k] <= 90 * score[p]][:10]
            out += [(i, kept[p][0], r + 1, kept[k][0], score[p], score[k]) for r, k in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("anchors,shard", [(2048, 1 << 13), (3, 100)])
def test_hard_negatives(spark, monkeypatch, anchors, shard):
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", anchors)
    monkeypatch.setattr(negatives, "LEAST_SHARD_ROWS", shard)
    rows = hostile_vectors()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, row string, cell int")
    got = sorted(map(tuple, negatives.hard_negatives(table).collect()))
    assert got == brute_negatives(rows) and got
    if anchors < 2048:
        assert negatives.hard_negatives(table.limit(0)).count() == 0
        assert negatives.hard_negatives(table.where("vec_id < 0")).count() == 0
        assert negatives.hard_negatives(table.where("vec_id % 100 > 0")).count() == 0


def test_cells_are_left_out():
    """Far cells don't serve an anchor whose best are near."""
    rng = np.random.default_rng(7)
    q = np.concatenate([rng.integers(900, 1000, (200, 4)), rng.integers(-1000, -900, (200, 4))])
    bound = float((q * q).sum(1).max())
    pivots = type("Sent", (), {"value": (np.arange(400), np.zeros(400, int), q)})()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"vec_id": [1000], "label": [0], "group": [0], "q": pa.array([[950] * 4], pa.list_(pa.int32()))})
    spans = next(negatives._spans(pivots, bound, 5, 0)(iter([batch])))
    first = dict(zip(spans.column(1).to_pylist(), spans.column(2).to_pylist()))
    far = np.sqrt(((q[200:] - q[0]) ** 2).sum(1)).min()
    # Rows near a far cell's pivot aren't sent; those near a near one's are.
    assert all(first.get(c, np.inf) > far / 2 for c in range(200, 400)) and all(first[c] < far / 4 for c in range(200))


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted(((i, floors(v, 1024), l) for i, v, l in rows if sound(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([v for _, v, _ in kept])
    code, error, books = [], 0, []
    for s, e in codes.cuts(10, parts):
        part = x[:, s:e].astype(object)
        book = [list(r) for r in part[:entries]]
        for k in range(rounds + 1):
            far = np.array([[sum((a - b) ** 2 for a, b in zip(r, c)) for c in book] for r in part.tolist()], dtype=object)
            best = [min(range(len(book)), key=lambda j: (row[j], j)) for row in far]
            if k < rounds:
                for j in range(len(book)):
                    mine = [r for r, b in zip(part.tolist(), best) if b == j]
                    book[j] = [sum(c) // len(mine) for c in zip(*mine)] if mine else book[j]
        code.append(best)
        error = error + np.array([far[k][b] for k, b in enumerate(best)], dtype=object)
        books += [c for r in book for c in r]
    digest = hashlib.sha256(",".join(str(int(c)) for c in books).encode()).hexdigest()
    return sorted(((i, "".join(f"{c[k]:02x}" for c in code), int(error[k]), l) for k, (i, _, l) in enumerate(kept)), key=str), digest


def test_vector_codes(spark):
    rows = [r for r in hostile_vectors() if r[0] is None or r[0] % 3]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, entry string, q int")
    made = codes.compress(table)
    want, digest = brute_codes(rows)
    got = codes.with_label_errors(made.rows).collect()
    assert made.sha256() == digest
    assert sorted(((r.vec_id, "".join(f"{e:02x}" for e in r.entry), r.error, None if r.label is None else int(r.label)) for r in got), key=str) == want
    totals = {}
    for r in got:
        totals[r.label] = totals.get(r.label, 0) + r.error
    assert all(r.label_error == totals[r.label] for r in got) and None in totals
    assert codes.compress(table.limit(0)).rows.count() == 0 and codes.compress(table.limit(0)).codebooks == []
    few = codes.compress(table.where("vec_id < 10"))
    assert {r.error for r in few.rows.collect()} == {0} and len(few.codebooks[0]) == few.rows.count()


def test_bounds_skip_scans_and_change_nothing():
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((4000, 4)) + 30 * rng.integers(0, 8, (4000, 1))) * 100 // 1
    x = x.astype(np.int64)
    entries = x[:40].copy()
    book, entry, upper, lower, scans = codes.Codebook.of(entries), np.full(4000, -1), np.zeros(4000), np.zeros(4000), []
    for _ in range(8):
        entry, upper, lower, _, n = codes.assign(x, book, entry, upper, lower)
        scans.append(n)
        assert (entry == codes.squares(x, book.entries).argmin(1)).all()
        new = book.entries.copy()
        for j in np.unique(entry):
            new[j] = x[entry == j].sum(0) // (entry == j).sum()
        book = codes.Codebook.of(new, book.entries)
    assert scans[0] == 4000 and scans[-1] < 2000


def test_ties_go_to_the_lower_entry():
    book = codes.Codebook.of(np.array([[0, 0], [4, 0], [0, 0]]))
    entry, upper, lower, error, n = codes.assign(np.array([[2, 0], [0, 0]]), book, np.array([-1, -1]), np.zeros(2), np.zeros(2), exact=True)
    assert entry.tolist() == [0, 0] and error.tolist() == [4, 0] and lower.tolist() == [2, 0]
    again = codes.assign(np.array([[2, 0], [0, 0]]), codes.Codebook.of(book.entries, book.entries), np.array([0, 0]), upper, lower)
    assert again[0].tolist() == [0, 0] and again[4] == 2

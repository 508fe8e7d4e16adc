"""Warp chains, hash pairs in tiles, and replaced tables, against plain versions."""

import random

import numpy as np
import pytest
from leafmill.functions import image
from leafmill.functions.text import squash
from leafmill.operators import resolve
from leafmill.plans import inputs
from leafmill.sources import sinks
from oracle import assert_matches


@pytest.mark.parametrize("name", sorted(inputs.ORACLES))
def test_same_as_sql(spark, data, name):
    assert assert_matches(spark, data, inputs.QUERIES[name], inputs.ORACLES[name])


STEP = "page int, pos int, kind string, matrix array<double>, w double, h double"


def back(steps, x, y):
    """A point through the steps one after the other, the last first."""
    p, margin = np.array([x, y, 1.0]), 1e6
    for _, _, kind, matrix, w, h in sorted(steps, key=lambda s: -s[1]):
        if kind == "clip":
            px, py = p[:2] / p[2]
            margin = min(margin, px + 0.5, w - 0.5 - px, py + 0.5, h - 0.5 - py)
        else:
            p = np.linalg.inv(np.array(matrix).reshape(3, 3)) @ p
    return (*(p[:2] / p[2]), margin)


def test_chains_fold_to_one_map(spark):
    rng = np.random.default_rng(1)
    steps = []
    for page in range(30):
        for pos in rng.permutation(int(rng.integers(0, 9))):
            if rng.random() < 0.3:
                steps.append((page, int(pos), "clip", None, float(rng.uniform(50, 200)), float(rng.uniform(50, 200))))
            else:
                m = np.eye(3) + rng.normal(0, [[0.2, 0.2, 20], [0.2, 0.2, 20], [1e-4, 1e-4, 0.1]])
                steps.append((page, int(pos), "homography", (m * rng.choice([1, -3, 1e6])).ravel().tolist(), None, None))
    points = [(page, float(rng.uniform(0, 150)), float(rng.uniform(0, 150))) for page in range(32) for _ in range(4)]
    out = resolve.source_points(spark.createDataFrame(points, "page int, x double, y double"), spark.createDataFrame(steps, STEP)).collect()
    assert len(out) == len(points)
    for r in out:
        want = back([s for s in steps if s[0] == r.page], r.x, r.y)
        assert np.allclose([r.source_x, r.source_y, r.margin], want, rtol=1e-6, atol=1e-6)
    assert {r.margin for r in out if r.page > 29} == {1e6}


def test_one_map_is_the_kernels_composition():
    a, b = np.array([[1, 0.1, 5], [0, 2, 3], [1e-3, 0, 1.0]]), np.array([[0.5, 0, -2], [0.2, 1, 0], [0, 1e-3, 1.0]])
    points = np.array([[3.0, 4.0], [50.0, 7.0]])
    assert np.allclose(image.project(image.compose(a, b), points), image.project(b, image.project(a, points)))


@pytest.mark.parametrize("tile", [4096, 7])
def test_hash_pairs_meet_once(spark, monkeypatch, tile):
    monkeypatch.setattr(resolve, "TILE", tile)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = [(k % 3 if k % 10 else None, k, f"{rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)):016x}") for k in range(60)] + [(1, 100, "f" * 16), (1, 101, "0" * 16), (1, 102, "f" * 15 + "e")]
    got = sorted(tuple(r) for r in resolve.hamming_pairs(spark.createDataFrame(rows, "label int, id long, hash string"), 4).collect())
    want = sorted((a[0], a[1], b[1], d) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1] and (d := bin(int(a[2], 16) ^ int(b[2], 16)).count("1")) <= 4)
    assert got == want and len(got) > 20


def test_pages_of_passages_of_any_length(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(12)]
    plain = [t.replace(" ", "") for t in texts]
    asked = [(k, p[s : s + n]) for k, (p, s, n) in enumerate((rng.choice(plain), rng.randrange(150), n) for n in list(range(8, 70)) + [160, 161, 200])]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_ord long, text string")
    got = dict(tuple(r) for r in resolve.first_containing(spark.createDataFrame(asked, "snippet_id long, text string"), pages).collect())
    assert got == {k: min(i for i, p in enumerate(plain) if t[:160] in p) for k, t in asked if len(t) >= 12}


def test_passages_that_share_pieces_with_every_page_stay_apart(spark):
    words = ["w%03d" % k for k in range(60)]
    rng = random.Random(5)
    pages = spark.createDataFrame([("b%d" % (k % 2), k, " ".join(rng.choices(words, k=60)) + " uniq%06dend" % k) for k in range(80)], "book string, page_ord long, text string")
    asked = spark.createDataFrame([("b%d" % (k % 2), k, "Uniq %06d-end" % k) for k in range(80)] + [("b0", 99, "nowhere to be found")], "book string, snippet_id long, text string")
    squashed = lambda df: df.withColumn("body", squash(df.text))
    want = {(r.book, r.snippet_id, p.page_ord) for r in squashed(asked).collect() for p in squashed(pages).collect() if r.book == p.book and r.body in p.body}
    pairs = resolve.candidate_pages(squashed(asked).select("book", "body").withColumnRenamed("body", "target").distinct(), squashed(pages).select("book", "page_ord", "body"), ["book"])
    assert pairs.distinct().count() <= 82
    got = {(r.book, r.snippet_id, r.page_ord) for r in resolve.first_containing(asked, pages, ["book"]).collect()}
    assert got == want and len(want) == 80


def test_a_table_that_was_moved_aside_comes_back(spark, tmp_path):
    path = tmp_path / "t"
    sinks.snapshot(spark.range(3), str(path))
    path.rename(tmp_path / "t.old")  # a run ended between the two renames
    sinks.recovered(spark, str(path))
    assert spark.read.parquet(str(path)).count() == 3
    path.rename(tmp_path / "t.old")
    sinks.snapshot(spark.range(5), str(path))
    assert spark.read.parquet(str(path)).count() == 5 and not (tmp_path / "t.old").exists()


def test_score_files_do_not_grow_with_videos(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id as event_id", "id div 4 as user_id", "id / 8.0D as value", "if(id % 3 = 0, 'error', 'view') as event_type")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    out = inputs.frame_scores(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted((f"v{i // 4}_f{i}", i / 8, 0.5 if i % 3 else 0.0, f"v{i // 4}") for i in range(2000))
    assert len(out.inputFiles()) <= 200

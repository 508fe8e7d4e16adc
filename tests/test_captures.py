import numpy as np
from leafmill.functions import image
from leafmill.operators import captures
from leafmill.plans import config


def test_image_kernels():
    rng = np.random.default_rng(1)
    page = rng.integers(0, 255, (96, 64)).astype(np.uint8)
    assert image.sharpness(page) > image.sharpness(np.full((96, 64), 9)) == 0
    assert image.motion(None, page) == 0 and image.motion(page, page) == 0
    assert image.perceptual_hash(page) == image.perceptual_hash(page) and len(image.perceptual_hash(page)) == 16
    corners = np.array([[9, 9], [0, 0], [0, 9], [9, 0]], float)
    assert image.order_quad(corners).tolist() == [[0, 0], [9, 0], [9, 9], [0, 9]]
    assert image.pad_quad(np.array([[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]]), 0.5).max() == 1


def test_composed_maps_equal_one_after_the_other():
    a = np.array([[1, 0.1, 3], [0, 1.2, 1], [0.001, 0, 1]])
    b = np.array([[0.9, 0, 0], [0.2, 1, 5], [0, 0.002, 1]])
    points = np.array([[1.0, 2], [30, 4], [5, 60]])
    assert np.allclose(image.project(image.compose(a, b), points), image.project(b, image.project(a, points)))


def test_layers():
    assert config.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}, {"b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    assert config.from_environment({"LEAFMILL_OCR__LANES": "3", "LEAFMILL_ON": "true", "X": "1"}) == {"ocr": {"lanes": 3}, "on": True}


def test_greedy_boxes_use_each_once(spark):
    fields = "page long, {} long, x0 double, y0 double, x1 double, y1 double"
    regions = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 0.5), (1, 1, 0.1, 0.1, 0.6, 0.6), (1, 2, 0.9, 0.9, 1.0, 1.0)], fields.format("region"))
    boxes = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.5, 0.5), (1, 8, 0.1, 0.1, 0.2, 0.2)], fields.format("box"))
    assert sorted(map(tuple, captures.greedy_boxes(regions, boxes).collect())) == [(1, 0, 7), (1, 1, 8)]


def test_figure_leaders(spark):
    rows = spark.createDataFrame([(1, 1, "0" * 16), (1, 2, "0" * 15 + "1"), (1, 3, "f" * 16), (2, 4, "0" * 16)], "label int, id long, hash string")
    assert [r.leader for r in captures.figure_clusters(rows).orderBy("id").collect()] == [1, 1, 3, 4]


def test_clusters_are_those_of_a_plain_pass(spark):
    """Copies, chains and several tiles; each hash is compared once, and no pair of rows is made of those that are far apart."""
    import random

    from leafmill.operators import resolve

    dice, rows = random.Random(5), []
    for i in range(900):
        bits = dice.choice(rows)[2] ^ (1 << dice.randrange(64)) if rows and dice.random() < 0.4 else dice.choice(rows)[2] if rows and dice.random() < 0.2 else dice.getrandbits(64)
        rows.append((i % 2, i, bits))
    want, leaders = {}, {0: [], 1: []}
    for label, i, bits in rows:
        want[i] = next((k for k, b in leaders[label] if (b ^ bits).bit_count() <= 18), i)
        if want[i] == i:
            leaders[label].append((i, bits))
    hashes = spark.createDataFrame([(label, i, f"{bits:016x}") for label, i, bits in rows], "label int, id long, hash string")
    before, resolve.TILE = resolve.TILE, 100
    try:
        got = {r.id: r.leader for r in captures.figure_clusters(hashes, 18).collect()}
        plan = captures.figure_clusters(hashes, 18)._jdf.queryExecution().executedPlan().toString()
    finally:
        resolve.TILE = before
    assert got == want and len(set(got.values())) < 700
    assert "bit_count" not in plan

"""Outlines of masks against a flood fill, and the choice of a card that follows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import layout, outlines


def flooded(mask):
    """The parts of a mask as sets of (x, y), in the order of their first pixels."""
    h, w = mask.shape
    left, out = {(x, y) for y in range(h) for x in range(w) if mask[y, x]}, []
    for y in range(h):
        for x in range(w):
            if (x, y) in left:
                todo, part = [(x, y)], set()
                left.discard((x, y))
                while todo:
                    a, b = todo.pop()
                    part.add((a, b))
                    for p in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if p in left:
                            left.discard(p)
                            todo.append(p)
                out.append(part)
    return out


def masks(spark, images):
    return spark.createDataFrame([(i, m.shape[1], m.shape[0], bytearray(m.astype(np.uint8).tobytes())) for i, m in enumerate(images)], "doc_id long, width int, height int, pixels binary")


def inside(shape, p):
    turns = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(shape, shape[1:] + shape[:1], strict=True)]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def test_parts_equal_a_flood_fill(spark):
    rng = random.Random(9)
    images = [np.array([[rng.random() < share for _ in range(w)] for _ in range(h)]) for w, h, share in ((1, 1, 1), (9, 1, 0.5), (1, 9, 0.5), (17, 13, 0.3), (30, 30, 0.45), (40, 25, 0.6), (8, 8, 0), (12, 12, 1))]
    got = {}
    for r in outlines.outlines(masks(spark, images)).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.pixels, r.x, r.y, r.w, r.h))
    for i, m in enumerate(images):
        expected = [(len(p), min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p) - min(x for x, _ in p) + 1, max(y for _, y in p) - min(y for _, y in p) + 1) for p in flooded(m)]
        assert got.get(i, []) == expected


@pytest.mark.parametrize("seed", range(20))
def test_hulls_hold_all_points_and_turn_one_way(seed):
    rng = random.Random(seed)
    points = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 25))]
    shape = outlines.hull(points)
    assert set(shape) <= set(points) and (len(shape) < 3 or all(inside(shape, p) for p in points))
    assert set(outlines.simplified(shape)) <= set(shape)


def test_a_card_is_chosen_from_its_mask(spark):
    def card(corners, w=300, h=220):
        y, x = np.mgrid[:h, :w]
        return np.logical_and.reduce([(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])

    corners = [(40, 30), (250, 45), (245, 180), (35, 165)]
    ring = card(corners) & ~card([(50, 40), (240, 55), (235, 170), (45, 155)])
    round_ = (np.mgrid[:220, :300][1] - 150) ** 2 / 1.6**2 + (np.mgrid[:220, :300][0] - 110) ** 2 < 80**2
    specks = np.zeros((220, 300), bool)
    specks[::9, ::9] = True
    found = outlines.outlines(masks(spark, [card(corners), ring, round_, specks]), least_pixels=30)
    images = spark.createDataFrame([(i, 300, 220) for i in range(4)], "doc_id long, width int, height int")
    chosen = {r.doc_id: r for r in layout.choose_card(images, found.filter("points IS NOT NULL"), found).collect()}
    for i in (0, 1):
        assert chosen[i].method == "quadrilateral" and np.abs(np.array(chosen[i].corners) - corners).max() <= 2
    assert chosen[2].method == "bounding_box_fallback" and chosen[3].method == "original_image"


def test_odd_masks_have_no_parts(spark):
    rows = [(1, 2, 2, bytearray(b"abc")), (2, None, 2, bytearray(b"ab")), (3, 1, 1, None), (4, 0, 0, bytearray(b"")), (None, 1, 2, bytearray(b"\x00a"))]
    df = spark.createDataFrame(rows, "doc_id long, width int, height int, pixels binary").withColumns({c: F.lit(1) for c in ("x", "ord", "area")})
    assert [(r.doc_id, r.pixels, r.y, r.points) for r in outlines.outlines(df).collect()] == [(None, 1, 1, None)]
    assert outlines.outlines(df.limit(0)).count() == 0


def test_the_query_over_all_documents(spark):
    from cardloom.plans import queries

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in queries.v04_outlines(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.ord, r.pixels))
    shown = queries.raster.binarised(queries._rasters(spark, sf), "text").collect()
    assert len(shown) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in shown:
        parts = flooded(np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width))
        assert sorted(got.get(r.image_id, [])) == [(i, len(p)) for i, p in enumerate(parts)]

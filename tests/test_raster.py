"""Rasters against brute force, pixel by pixel."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import raster


def image(rng, h, w):
    return np.array([[min(255, max(0, int(120 + 60 * math.sin(x / 3) + rng.gauss(0, 40)))) for x in range(w)] for _ in range(h)], np.uint8)


def edge(img, y, x):
    return int(img[min(max(y, 0), img.shape[0] - 1), min(max(x, 0), img.shape[1] - 1)])


def brute_mean(img, y, x, window):
    w, half = raster.weights(window).tolist(), window // 2
    return (sum(w[i] * w[j] * edge(img, y + i - half, x + j - half) for i in range(window) for j in range(window)) + (1 << 31)) >> 32


@pytest.mark.parametrize("window", [3, 11, 31])
def test_weights_are_a_bell(window):
    w = raster.weights(window)
    assert w.sum() == 65_536 and (w == w[::-1]).all() and (np.diff(w)[: window // 2] >= 0).all() and w.min() >= 0


@pytest.mark.parametrize(("use", "shape"), [("text", (9, 13)), ("page", (7, 20)), ("field", (17, 33)), ("text", (1, 1)), ("page", (1, 5))])
def test_threshold_equals_brute_force(spark, use, shape):
    img, (window, offset) = image(random.Random(3), *shape), raster.THRESHOLDS[use]
    grey = img
    if use == "field":
        grey = raster.equalised(img)
        grey = np.array([[brute_mean(grey, y, x, 3) for x in range(shape[1])] for y in range(shape[0])], np.uint8)
    expected = np.array([[255 if int(grey[y, x]) > brute_mean(grey, y, x, window) - offset else 0 for x in range(shape[1])] for y in range(shape[0])])
    if use == "page":
        expected = np.array([[sorted(edge(expected, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1))[4] for x in range(shape[1])] for y in range(shape[0])])
    df = spark.createDataFrame([(1, shape[1], shape[0], bytearray(img.tobytes()))], "image_id long, width int, height int, pixels binary")
    got = raster.binarised(df, use).first()
    assert got.error is None and bytes(got.pixels) == expected.astype(np.uint8).tobytes()


def test_equalisation_equals_brute_force():
    img = image(random.Random(4), 37, 50)
    high, wide, area = 5, 7, 35
    padded = np.pad(img, ((0, 3), (0, 6)), mode="reflect")
    curves = {}
    for i in range(8):
        for j in range(8):
            tile, count = padded[i * high : (i + 1) * high, j * wide : (j + 1) * wide].ravel().tolist(), [0] * 256
            for v in tile:
                count[v] += 1
            most = max(1, int(2.0 * area / 256))
            over = sum(max(0, c - most) for c in count)
            count = [min(c, most) + over // 256 for c in count]
            step, left = max(256 // max(over % 256, 1), 1), over % 256
            for k in range(0, 256, step):
                if left:
                    count[k] += 1
                    left -= 1
            total, curve = 0, []
            for c in count:
                total += c
                curve.append(min(255, math.floor(total * 255 / area + 0.5)))
            curves[i, j] = curve
    got = raster.equalised(img)
    for y in range(37):
        for x in range(50):
            ty, tx = (y + 0.5) / high - 0.5, (x + 0.5) / wide - 0.5
            i, j = math.floor(ty), math.floor(tx)
            c = lambda a, b: curves[min(max(a, 0), 7), min(max(b, 0), 7)][img[y, x]]  # noqa: E731, B023
            mixed = (c(i, j) * (1 - tx + j) + c(i, j + 1) * (tx - j)) * (1 - ty + i) + (c(i + 1, j) * (1 - tx + j) + c(i + 1, j + 1) * (tx - j)) * (ty - i)
            assert abs(int(got[y, x]) - mixed) <= 0.5 + 1e-9


def test_corners_map_exactly_and_pixels_mix(spark):
    corners = [(3.0, 2.0), (40.0, 5.0), (37.0, 28.0), (1.0, 25.0)]
    target = [(0, 0), (59, 0), (59, 39), (0, 39)]
    m = raster.homography(target, corners)
    for (u, v), (x, y) in zip(target, corners, strict=True):
        p = m @ [u, v, 1]
        assert p[:2] / p[2] == pytest.approx((x, y))
    img = image(random.Random(5), 30, 44)
    got = raster.warped(img, corners, 60, 40)
    for v in range(40):
        for u in range(60):
            x, y, z = m @ [u, v, 1]
            x, y = x / z, y / z
            i, j = math.floor(y), math.floor(x)
            px = lambda a, b: int(img[a, b]) if 0 <= a < 30 and 0 <= b < 44 else 0
            mixed = sum(px(i + a, j + b) * (1 - abs(y - i - a)) * (1 - abs(x - j - b)) for a in (0, 1) for b in (0, 1))
            assert abs(int(got[v, u]) - mixed) <= 0.5 + 1e-6
    # The whole raster onto its own size is itself; what lies outside is black.
    assert (raster.warped(img, [(0, 0), (43, 0), (43, 29), (0, 29)], 44, 30) == img).all()
    assert (raster.warped(img, [(100, 100), (120, 100), (120, 120), (100, 120)], 8, 8) == 0).all()
    df = spark.createDataFrame([(1, 44, 30, bytearray(img.tobytes()), [list(c) for c in corners])], "image_id long, width int, height int, pixels binary, corners array<array<double>>")
    row = raster.rectified(df, size=(60, 40)).first()
    assert (row.width, row.height, bytes(row.pixels)) == (60, 40, got.tobytes())


def test_what_is_no_raster_comes_back(spark):
    rows = [(1, 2, 2, bytearray(b"abc"), [[0.0, 0.0]] * 4), (2, None, 2, bytearray(b"ab"), None), (3, 1, 1, None, None), (4, 0, 0, bytearray(b""), None), (5, 1, 2, bytearray(b"ab"), [[0.0, 0.0]] * 3), (6, 1, 2, bytearray(b"ab"), [[0.0, 0.0]] * 4)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary, corners array<array<double>>").withColumns({"error": F.lit("clash"), "x": F.lit(1)})
    out = {r.image_id: r for r in raster.binarised(df, "text").collect()}
    assert [i for i in sorted(out) if out[i].error] == [1, 2, 3, 4] and bytes(out[1].pixels) == b"abc" and out[3].pixels is None and out[6].x == 1
    out = {r.image_id: r.error for r in raster.rectified(df, size=(4, 3)).collect()}
    assert all(out.values()) and out[5] == "no four corners" and "ingular" in out[6]
    assert raster.binarised(df.limit(0), "page").count() == 0


@pytest.mark.parametrize(("name", "use"), [("v05_field_threshold", "field"), ("v06_page_threshold", "page")])
def test_queries_over_all_documents(spark, name, use):
    import hashlib

    from cardloom.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.image_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert set(got) == set(rows) and not any(r.error for r in got.values())
    window, offset = raster.THRESHOLDS[use]
    for i in sorted(rows, key=lambda i: len(rows[i]))[:3]:
        h = max(1, -(-len(rows[i]) // 24))
        grey = np.frombuffer(rows[i].ljust(24 * h, b"\0"), np.uint8).reshape(h, 24)
        if use == "field":
            grey = raster.equalised(grey)
            grey = np.array([[brute_mean(grey, y, x, 3) for x in range(24)] for y in range(h)], np.uint8)
        out = np.array([[255 if int(grey[y, x]) > brute_mean(grey, y, x, window) - offset else 0 for x in range(24)] for y in range(h)])
        if use == "page":
            out = np.array([[sorted(edge(out, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1))[4] for x in range(24)] for y in range(h)])
        assert got[i].sha256 == hashlib.sha256(out.astype(np.uint8).tobytes()).hexdigest()
    assert queries.v03_rectified(spark, sf).filter("error IS NULL AND width = 48 AND height = 30").count() > 0

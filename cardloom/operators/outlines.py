"""Outlines of the connected parts of a mask, for the choice of a card among them (see `layout.choose_card`).

A mask is a raster (doc_id, width, height, pixels) whose pixels are part of something or 0. Its rows are cut into runs;
runs that touch those of the row before, corners included, are one part. Each mask is worked on by itself, in Arrow
batches and without a shuffle, and is held as runs: what a part costs follows from its runs and not from its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how far a corner may lie off the line between others, as a share of the outline's length.
CORNER = 0.03
_SCHEMA = "doc_id long, ord int, pixels long, area double, points array<array<double>>, x int, y int, w int, h int"
Point = tuple[int, int]


def runs(mask: np.ndarray) -> np.ndarray:
    """(row, first, last) of every run of a mask's rows."""
    edges = np.diff(np.pad((mask != 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    return np.stack([row, first, np.nonzero(edges == -1)[1] - 1], axis=1)


def parts(found: np.ndarray) -> np.ndarray:
    """Of every run the number of its part, by the first run of each."""
    parent = list(range(len(found)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    rows = np.searchsorted(found[:, 0], np.arange(found[-1, 0] + 2)) if len(found) else np.zeros(1, int)
    first, last = found[:, 1].tolist(), found[:, 2].tolist()
    for y in range(1, len(rows) - 1):
        i, j = int(rows[y - 1]), int(rows[y])
        while i < rows[y] and j < rows[y + 1]:
            if first[i] <= last[j] + 1 and first[j] <= last[i] + 1:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if last[i] <= last[j]:
                i += 1
            else:
                j += 1
    return np.unique([root(i) for i in range(len(found))], return_inverse=True)[1]


def hull(points: list[Point]) -> list[Point]:
    """The corners of the smallest convex outline, clockwise on a raster, from the least x."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for side in (points, points[::-1]):
        half: list[Point] = []
        for p in side:
            while len(half) > 1 and cross(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def simplified(outline: list[Point], share: float = CORNER) -> list[Point]:
    """The outline's corners that lie further than `share` of its length from the line between those around them, from two far apart on."""
    if len(outline) < 3:
        return outline
    at = np.array(outline, float)
    off = share * np.hypot(*(np.roll(at, -1, axis=0) - at).T).sum()
    far = int(((at - at[0]) ** 2).sum(axis=1).argmax())
    kept, todo = {0, far}, [(0, far), (far, len(at))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = at[a], at[b % len(at)]
        d = q - p
        between = at[a + 1 : b] - p
        gap = np.abs(d[0] * between[:, 1] - d[1] * between[:, 0]) / max(np.hypot(*d), 1e-12)
        k = int(gap.argmax())
        if gap[k] > off:
            kept.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return [outline[i] for i in sorted(kept)]


def outlines(masks: DataFrame, *, least_pixels: int = 1) -> DataFrame:
    """(doc_id, ord, pixels, area, points, x, y, w, h) of the parts of every mask, in the order of their first pixels.

    `area` is that of the convex outline through the pixels' middles; `points` are its four corners where it comes down
    to four, else null; x, y, w and h are the box. Parts of fewer than `least_pixels` are left out, as a parameter for
    specks. A mask that can't be read (nulls, or as many bytes as its size doesn't say) has no parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.list_(pa.float64())), *[pa.int32()] * 4]
        for batch in batches:
            for k in range(batch.num_rows):
                doc, width, height, pixels = (batch.column(c)[k].as_py() for c in ("doc_id", "width", "height", "pixels"))
                if width is None or height is None or pixels is None or len(pixels) != width * height or not pixels:
                    continue
                found = runs(np.frombuffer(pixels, np.uint8).reshape(height, width))
                part, out = parts(found), []
                for n in range(part.max(initial=-1) + 1):
                    own = found[part == n]
                    count = int((own[:, 2] - own[:, 1] + 1).sum())
                    if count < least_pixels:
                        continue
                    shape = hull([(x, y) for y, a, b in own.tolist() for x in (a, b)])
                    at = np.array(shape, float)
                    area = abs(float((at[:, 0] * np.roll(at[:, 1], -1) - at[:, 1] * np.roll(at[:, 0], -1)).sum())) / 2
                    corners = simplified(shape)
                    x, y = int(own[:, 1].min()), int(own[0, 0])
                    out.append((doc, len(out), count, area, [[float(c) for c in p] for p in corners] if len(corners) == 4 else None, x, y, int(own[:, 2].max()) - x + 1, int(own[-1, 0]) - y + 1))
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(list(zip(*out, strict=True)) or [()] * len(names), kinds, strict=True)], names)

    return masks.select(F.col("doc_id").cast("long").alias("doc_id"), "width", "height", "pixels").mapInArrow(run, _SCHEMA)

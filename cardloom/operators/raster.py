"""Grey rasters as rows: binarisation by a local threshold and rectification of a card's quadrilateral.

A raster is a row (image_id, width, height, pixels), `pixels` its bytes from the top left. Each is worked on by itself,
in Arrow batches and without a shuffle, a strip of its rows at a time where that saves memory. Weights are whole
numbers, so outcomes don't depend on the order of sums. A raster that can't be read (nulls, or as many bytes as its size
doesn't say) comes back as it was, with an `error`; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

# The window and offset of each use of the local threshold.
THRESHOLDS = {"field": (31, 7), "page": (31, 2), "text": (11, 2)}
# Contrast limit and tiles of the equalisation before fields are read; the size of a rectified card.
CLIP, TILES = 2.0, 8
CARD = (1712, 1080)
#: Output rows that are sampled at a time.
STRIP = 128


def weights(window: int) -> np.ndarray:
    """Gaussian weights of a window as whole numbers that sum to 65,536; the middle one takes what rounding leaves."""
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    at = np.arange(window) - (window - 1) / 2
    g = np.exp(-(at**2) / (2 * sigma**2))
    out = np.floor(g / g.sum() * 65_536 + 0.5).astype(np.int64)
    out[window // 2] += 65_536 - out.sum()
    return out


def smoothed(image: np.ndarray, window: int) -> np.ndarray:
    """The weighted mean around each pixel, rounded half up; edges go on as they end."""
    w, half = weights(window), window // 2
    wide = np.pad(image.astype(np.int64), half, mode="edge")
    across = sum(int(k) * wide[:, i : i + image.shape[1]] for i, k in enumerate(w))
    both = sum(int(k) * across[i : i + image.shape[0]] for i, k in enumerate(w))
    return (both + (1 << 31)) >> 32


def local_threshold(image: np.ndarray, window: int, offset: int) -> np.ndarray:
    """255 where a pixel is brighter than the mean around it less the offset, else 0."""
    return np.where(image > smoothed(image, window) - offset, 255, 0).astype(np.uint8)


def median3(image: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours; edges go on as they end."""
    wide = np.pad(image, 1, mode="edge")
    h, w = image.shape
    return np.sort(np.stack([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)[4]


def equalised(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast by the histogram of each of `tiles` x `tiles` tiles, cut at `clip` times its mean; pixels mix the four tiles around them."""
    h, w = image.shape
    high, wide = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, high * tiles - h), (0, wide * tiles - w)), mode="reflect" if min(h, w) > max(high * tiles - h, wide * tiles - w) else "edge")
    curves = np.empty((tiles, tiles, 256), np.int64)
    area, most = high * wide, max(1, int(clip * high * wide / 256))
    for i in range(tiles):
        for j in range(tiles):
            count = np.bincount(padded[i * high : (i + 1) * high, j * wide : (j + 1) * wide].ravel(), minlength=256)
            over = int(np.maximum(count - most, 0).sum())
            count = np.minimum(count, most) + over // 256
            if left := over % 256:
                count[:: max(256 // left, 1)][:left] += 1
            curves[i, j] = np.minimum((np.cumsum(count) * 255 * 2 + area) // (2 * area), 255)
    # Where a pixel lies between the middles of tiles, in 1/2 tile sizes: whole numbers throughout.
    y, x = 2 * np.arange(h) + 1 - high, 2 * np.arange(w) + 1 - wide
    i, j = y // (2 * high), x // (2 * wide)
    fy, fx = (y - i * 2 * high)[:, None], (x - j * 2 * wide)[None, :]
    row = lambda k: np.clip(k, 0, tiles - 1)
    at = lambda a, b: curves[row(a)[:, None], row(b)[None, :], image]
    top = at(i, j) * (2 * wide - fx) + at(i, j + 1) * fx
    low = at(i + 1, j) * (2 * wide - fx) + at(i + 1, j + 1) * fx
    whole = 4 * high * wide
    return ((top * (2 * high - fy) + low * fy + whole // 2) // whole).astype(np.uint8)


def homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The 3 x 3 map that takes four points to four points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def warped(image: np.ndarray, corners: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """The quadrilateral of `corners` (from the top left, clockwise) as an upright raster, sampled between pixels; outside is 0."""
    back = homography([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], corners)
    h, w = image.shape
    framed = np.pad(image.astype(np.float64), 1)
    out = np.empty((height, width), np.uint8)
    u = np.arange(width)
    for start in range(0, height, STRIP):
        v = np.arange(start, min(start + STRIP, height))[:, None]
        z = back[2, 0] * u + back[2, 1] * v + back[2, 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (back[0, 0] * u + back[0, 1] * v + back[0, 2]) / z, (back[1, 0] * u + back[1, 1] * v + back[1, 2]) / z
        x, y = (np.clip(np.where(np.isfinite(c), c, -1.0), -1, most) for c, most in ((x, w), (y, h)))
        i, j = np.minimum(np.floor(y), h - 1).astype(int), np.minimum(np.floor(x), w - 1).astype(int)
        fy, fx = y - i, x - j
        i, j = i + 1, j + 1
        mixed = (framed[i, j] * (1 - fx) + framed[i, j + 1] * fx) * (1 - fy) + (framed[i + 1, j] * (1 - fx) + framed[i + 1, j + 1] * fx) * fy
        out[start : start + STRIP] = np.floor(mixed + 0.5)
    return out


def _mapped(images: DataFrame, work: Callable[[np.ndarray, dict], np.ndarray], more: list[str] | None = None) -> DataFrame:
    """`images` with `width`, `height` and `pixels` of what `work` makes of each, and `error`."""
    names = [c for c in images.columns if c != "error"]
    kinds = {"width": IntegerType(), "height": IntegerType(), "pixels": BinaryType()}
    schema = StructType([StructField(c, kinds.get(c, images.schema[c].dataType)) for c in names] + [StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                width, height, pixels = (one.column(c)[0].as_py() for c in ("width", "height", "pixels"))
                error = None
                try:
                    if width is None or height is None or pixels is None or width < 1 or height < 1 or len(pixels) != width * height:
                        raise ValueError("no raster of its size")
                    made = work(np.frombuffer(pixels, np.uint8).reshape(height, width), {c: one.column(c)[0].as_py() for c in more or ()})
                    (height, width), pixels = made.shape, made.tobytes()
                except (ValueError, TypeError, np.linalg.LinAlgError) as why:
                    error = str(why)
                new = {"width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "pixels": pa.array([pixels], pa.binary())}
                yield pa.record_batch([*(new.get(c, one.column(c)) for c in names), pa.array([error], pa.string())], [*names, "error"])

    return images.select(*(images[f"`{c}`"] for c in names)).mapInArrow(run, schema)


def binarised(images: DataFrame, use: str) -> DataFrame:
    """Rasters in black and white for a use of `THRESHOLDS`: `field` is equalised and smoothed first, `page` loses single dots after."""
    window, offset = THRESHOLDS[use]

    def work(image: np.ndarray, _: dict) -> np.ndarray:
        if use == "field":
            image = smoothed(equalised(image), 3).astype(np.uint8)
        out = local_threshold(image, window, offset)
        return median3(out) if use == "page" else out

    return _mapped(images, work)


def rectified(images: DataFrame, corners: str = "corners", size: tuple[int, int] = CARD) -> DataFrame:
    """Rasters of `size` of the quadrilateral in a column of four points [x, y] from the top left, clockwise (see `layout.order_corners`)."""

    def work(image: np.ndarray, row: dict) -> np.ndarray:
        points = row[corners]
        if points is None or len(points) != 4 or any(p is None or len(p) != 2 or None in p for p in points):
            raise ValueError("no four corners")
        return warped(image, points, *size)

    return _mapped(images, work, [corners])

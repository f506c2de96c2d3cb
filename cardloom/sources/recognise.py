"""The recogniser interface: pixels to page text and word boxes stay outside the engine.

A recogniser is a plain object that can be pickled. `pages`, `words` and `zones` run it over binary files, a file at a
time; what enters a Python worker at once is bounded by `spark.sql.execution.arrow.maxBytesPerBatch`. A file or page
that can't be read gives a row with an error and stops nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import layout

MOST_PAGES = 2
WORD_SCHEMA = "doc_id string, page_no int, config_ord int, word_ord int, text string, conf double, x int, y int, w int, h int, error string"
ZONE_SCHEMA = "doc_id string, page_no int, template string, field string, left int, top int, right int, bottom int, readings array<string>, error string"


class Recogniser(Protocol):
    """What an implementation with image libraries has to provide."""

    def page_texts(self, content: bytes) -> Iterable[str]:
        """The embedded text of every page; where pages are yielded, those behind the last one wanted aren't read."""

    def words(self, content: bytes, page: int) -> list[tuple[int, int, str, float, int, int, int, int]]:
        """The words of a page: mode, position, text, confidence, x, y, width, height."""

    def size(self, content: bytes, page: int) -> tuple[int, int] | None:
        """Width and height of a page in pixels, None if there is no such page."""

    def field(self, content: bytes, page: int, field: str, box: tuple[int, int, int, int]) -> list[str]:
        """The readings of a zone, one for each configuration."""


class PlainText:
    """Text files whose pages are parted by form feeds; they have no pixels to recognise."""

    def page_texts(self, content: bytes) -> Iterator[str]:
        yield from content.decode().split("\f")

    def words(self, content: bytes, page: int) -> list[tuple]:
        return []

    def size(self, content: bytes, page: int) -> None:
        return None

    def field(self, content: bytes, page: int, field: str, box: tuple[int, int, int, int]) -> list[str]:
        return []


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: path, content and the rest of the binary source."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _over_files(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[tuple]], failed: Callable[[str, str], tuple]) -> DataFrame:
    """The rows that `rows` gives for every file, `failed` for one that raises; a batch goes on as soon as a file is done."""
    names = [f.split()[0] for f in schema.split(", ")]
    integers = [f.split()[0] for f in schema.split(", ") if f.endswith(" int")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = list(rows(path, bytes(content)))
                except Exception as why:  # noqa: BLE001 - one bad file must not stop the others
                    found = [failed(path, str(why) or type(why).__name__)]
                yield pd.DataFrame(found, columns=names).astype(dict.fromkeys(integers, "Int32"))

    return files.select("path", "content").mapInPandas(run, schema)


def pages(files: DataFrame, recogniser: Recogniser) -> DataFrame:
    """(doc_id, page_no, text, error) of every page, from 1; a file that can't be read has one row with an error."""
    rows = lambda path, content: ((path, i, t, None) for i, t in enumerate(recogniser.page_texts(content), 1))
    return _over_files(files, "doc_id string, page_no int, text string, error string", rows, lambda path, why: (path, 1, None, why))


def words(files: DataFrame, recogniser: Recogniser) -> DataFrame:
    """The word boxes of the first two pages of every file; a file that can't be read has one row with an error."""
    rows = lambda path, content: ((path, page, *w, None) for page in range(1, MOST_PAGES + 1) for w in recogniser.words(content, page))
    return _over_files(files, WORD_SCHEMA, rows, lambda path, why: (path, 1, *[None] * 8, why))


def pixel_box(share: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int] | None:
    """A zone in shares of the page as left, top, right and bottom pixels; None if it is empty. As `layout.zone_boxes` has it."""
    cut = lambda a, b, n, most: int(min(1.0, max(0.0, (max if most else min)(a, b))) * n)
    x1, y1, x2, y2 = share
    box = cut(x1, x2, width, False), cut(y1, y2, height, False), cut(x1, x2, width, True), cut(y1, y2, height, True)
    return box if box[2] > box[0] and box[3] > box[1] else None


def zones(files: DataFrame, recogniser: Recogniser, model: str) -> DataFrame:
    """The readings of all zones of the first two pages of every file, with their boxes in pixels (see `layout.zone_values`).

    Pages that a file doesn't have and empty boxes have no rows; a file that can't be read has one row with an error.
    """

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        for page in range(1, MOST_PAGES + 1):
            if (size := recogniser.size(content, page)) is None:
                continue
            name = "digital" if model == "digital" else "anverso" if page == 1 else "reverso"
            for field, share in layout.ZONES[name].items():
                if box := pixel_box(share, *size):
                    yield (path, page, name, field, *box, list(recogniser.field(content, page, field, box)), None)

    return _over_files(files, ZONE_SCHEMA, rows, lambda path, why: (path, 1, *[None] * 7, why))


def first_pages(pages: DataFrame) -> DataFrame:
    """The pages that are recognised at all."""
    return pages.filter(F.col("page_no") <= MOST_PAGES)


def joined_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a document's pages that aren't blank, in order, each with a line end."""
    kept = pages.filter(T.strip(F.col("text")) != "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: F.concat(p["text"], F.lit("\n")))
    return kept.groupBy("doc_id").agg(F.array_join(parts, "").alias("text"))


def first_reading(*readings: Column) -> Column:
    """The first reading of a zone that isn't empty."""
    return F.coalesce(*(T.some(T.strip(r)) for r in readings))

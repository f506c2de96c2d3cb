"""Similarity of short texts by matching blocks, and what labels a page's lines resemble."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cardloom.functions import text as T


@lru_cache(1 << 18)
def _blocks(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else _blocks(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity_normal(a: Column, b: Column) -> Column:
    """Similarity of two texts that are normalised already; nulls count as empty. It depends on their order."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    native = T.similarity_case(a, b)
    # Rows that the native cases settle reach the UDF as null and cost nothing there.
    open_ = native.isNull()
    return F.coalesce(native, _ratio(F.when(open_, a), F.when(open_, b)))


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts from 0 to 1: 1 if equal after normalisation, 0.95 if one contains the other, else twice the matching blocks over both lengths."""
    return similarity_normal(T.normalize(a), T.normalize(b))


#: The characters that normalised texts have.
_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+#. "


def _bag(text: Column) -> Column:
    """How often each character stands in a normalised text."""
    return F.array(*(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _CHARACTERS))


@lru_cache(1 << 10)
def _matcher(label: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", label)


@lru_cache(1 << 16)
def _likenesses(text: str, labels: tuple[str, ...]) -> np.ndarray:
    """`likeness` of a normalised text to each label; what matching blocks need of a label is made once."""

    def blocks(label: str) -> float:
        m = _matcher(label)
        m.set_seq1(text)
        return m.ratio()

    return np.array([0.0 if not text or not x else 1.0 if text == x else 0.95 if text in x or x in text else blocks(x) for x in labels])


def form(text: Column, norms: tuple[str, ...]) -> Column:
    """A text, normalised, with one sign for all characters that none of the normalised labels has.

    Such characters match nothing wherever they stand, so a form is as similar to the labels as its text.
    """
    absent = "".join(sorted(set(_CHARACTERS) - set("".join(norms))))
    return F.translate(T.normalize(text), absent, "_" * len(absent))


def compared_with(rows: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """The other columns of `rows`, and for each of a fixed list of labels `label` and the `similarity` of a row's text to it.

    A row passes Python once, with all labels, and by its `form`: texts that differ by numbers alone are compared once.
    """
    known = tuple(plain(x) for x in labels)

    @F.arrow_udf(ArrayType(DoubleType()))
    def scores(forms: pa.Array) -> pa.Array:
        of = forms.dictionary_encode()
        each = np.array([_likenesses(x, known) for x in of.dictionary.to_pylist()]).reshape(len(of.dictionary), len(known))
        return pa.ListArray.from_arrays(np.arange(len(forms) + 1, dtype=np.int32) * len(known), each[of.indices.to_numpy()].ravel())

    others = [c for c in rows.columns if c != text]
    listed = rows.select(*others, F.posexplode(scores(form(F.col(text), known))).alias("_at", "similarity"))
    return listed.select(*others, F.get(F.array(*map(F.lit, labels)), F.col("_at")).alias("label"), "similarity")


def similar_pairs(texts: DataFrame, labels: list[str], least: float) -> DataFrame:
    """(text, label, similarity) of the pairs that are alike from `least` on, of normalised texts (one column) and a fixed list of labels.

    Every distinct text is compared once, however often it occurs. Matching blocks are no more than the characters that
    both texts have, nor longer than the shorter one; those two bounds and the cases without blocks are Spark's own
    expressions, so that Python gets only pairs that no bound settles (see `open_pairs`). Null and empty texts are alike
    to nothing.
    """
    pairs = _bounded(texts, labels, least)
    score = F.coalesce("native", _ratio(F.when(F.col("native").isNull(), F.col("text")), F.when(F.col("native").isNull(), F.col("label"))))
    return pairs.withColumn("similarity", score).filter(F.col("similarity") >= least).select("text", "label", "similarity")


def open_pairs(texts: DataFrame, labels: list[str], least: float) -> DataFrame:
    """(text, label): the pairs whose blocks `similar_pairs` has to match in Python."""
    return _bounded(texts, labels, least).filter("native IS NULL").select("text", "label")


def _bounded(texts: DataFrame, labels: list[str], least: float) -> DataFrame:
    text = F.col("text")
    known = sorted({x for x in labels if x})
    listed = F.array(*(F.struct(F.lit(x).alias("label"), F.lit(len(x)).alias("size"), F.array(*(F.lit(x.count(c)) for c in _CHARACTERS)).alias("bag")) for x in known))
    # Dealt by text, so that equal ones meet; the labels come to them, and bags are made of what the lengths let through.
    one = texts.toDF("text").filter("text <> ''").distinct().withColumn("size", F.length("text"))
    shorter, total = F.least(F.col("size"), F.col("l.size")), F.col("size") + F.col("l.size")
    x = one.select("text", "size", F.explode(listed).alias("l")).withColumn("native", T.similarity_case(text, F.col("l.label")))
    x = x.filter(F.coalesce(F.col("native"), 2.0 * shorter / total) >= least)
    shared = F.aggregate(F.zip_with(_bag(text), F.col("l.bag"), lambda a, b: F.least(a, b)), F.lit(0), lambda n, c: n + c)
    return x.filter(F.col("native").isNotNull() | (2.0 * shared / total >= least)).select("text", F.col("l.label").alias("label"), "native")


def plain(text: str) -> str:
    """`T.normalize` of one short text, for dictionaries."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.upper()) if unicodedata.category(c) != "Mn")
    return re.sub("[^A-Z0-9+#.]+", " ", bare).strip()


def likeness(a: str, b: str) -> float:
    """`similarity_normal` of two normalised texts."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.95 if a in b or b in a else _blocks(a, b)


class PageReader:
    """Compares a page's normalised lines with label dictionaries, the fields' and those of the two sides of a card."""

    #: Distinct lines and words whose outcomes are remembered.
    REMEMBERED = 1 << 16

    def __init__(self, labels: dict[str, tuple[str, ...]], sides: tuple[tuple[str, ...], tuple[str, ...]], find: float, exclude: float, side_word: float, inside: float):
        self.table = [(field, label, plain(label)) for field, variants in labels.items() for label in variants]
        self.sides = [[plain(label) for label in side] for side in sides]
        self.find, self.exclude, self.side_word, self.inside = find, exclude, side_word, inside
        self.lines: dict[str, tuple[list[tuple[str, str, str, float]], bool]] = {}
        self.words: dict[str, list[frozenset[str]]] = {}

    def by_line(self, norm: str) -> tuple[list[tuple[str, str, str, float]], bool]:
        """Of each field that a line resembles its best label, the first of equals; and whether the line counts as a label itself."""
        best: dict[str, tuple[str, str, float]] = {}
        pieces = [norm, *(w for w in norm.split() if len(w) >= 3)]
        labelled = False
        for field, label, label_norm in self.table:
            contained = label_norm != "" and label_norm in norm
            score = max(self.inside if contained else 0.0, *(likeness(p, label_norm) for p in pieces))
            labelled |= norm != "" and (contained or likeness(norm, label_norm) >= self.exclude)
            if score >= self.find and (field not in best or score > best[field][2]):
                best[field] = label, label_norm, score
        return [(f, *b) for f, b in best.items()], labelled

    def near_side(self, word: str) -> list[frozenset[str]]:
        return [frozenset(x for x in side if likeness(word, x) >= self.side_word) for side in self.sides]

    def read(self, norms: list[str]) -> dict:
        """What `page_reader` says of a page."""
        for known in (self.lines, self.words):
            if len(known) > self.REMEMBERED:
                known.clear()
        best: dict[str, dict] = {}
        flags = []
        for i, norm in enumerate(norms):
            if norm not in self.lines:
                self.lines[norm] = self.by_line(norm)
            hits, labelled = self.lines[norm]
            flags.append(labelled)
            for field, label, label_norm, score in hits:
                if field not in best or score > best[field]["score"]:
                    best[field] = {"field": field, "line": i, "label": label, "label_norm": label_norm, "score": score}
        text = re.sub(" +", " ", " ".join(norms)).strip()
        near = []
        for w in set(text.split()):
            if w not in self.words:
                self.words[w] = self.near_side(w)
            near.append(self.words[w])
        points = [sum(2 if x and x in text else int(any(x in n[k] for n in near)) for x in side) for k, side in enumerate(self.sides)]
        return {"found": list(best.values()), "is_label": flags, "front": points[0], "back": points[1]}


def page_reader(labels: dict[str, tuple[str, ...]], sides: tuple[tuple[str, ...], tuple[str, ...]], find: float, exclude: float, side_word: float, inside: float) -> Callable[[Column], Column]:
    """A function of a page's normalised lines, an array from the top, that compares them with label dictionaries.

    Its outcome is a struct: `found` (field, line, label, label_norm, score), of each field the line and label most
    alike from `find` on, the first line and label of equals; `is_label` by line, whether it contains a label or is
    alike from `exclude` on; `front` and `back`, the points of the two dictionaries of `sides`: two for a label inside
    the page's text, one for a word alike from `side_word` on. A label inside a line counts `inside`.
    """
    reader = PageReader(labels, sides, find, exclude, side_word, inside)
    schema = "found array<struct<field string, line int, label string, label_norm string, score double>>, is_label array<boolean>, front int, back int"

    @F.pandas_udf(schema)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reader.read(list(p)) for p in pages], columns=["found", "is_label", "front", "back"])

    return run

"""Reconciliation of competing values of a field: embedded text, labels found on the page, and zone crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions import text as T


def merge_text(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, value): of each field the valid value of the earliest page."""
    ok = T.valid(F.col("field"), F.col("value"))
    return candidates.filter(ok).groupBy("doc_id", "field").agg(F.min_by("value", "page_no").alias("value"))


def accumulate_general(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, value): of each field the valid value of the latest page."""
    ok = T.valid(F.col("field"), F.col("value"))
    return candidates.filter(ok).groupBy("doc_id", "field").agg(F.max_by("value", "page_no").alias("value"))


def accumulate_crop(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, value): of each field the cleaned value of the latest page that has one."""
    cleaned = candidates.withColumn("value", T.clean_field(F.col("field"), F.col("value"))).filter("value IS NOT NULL")
    return cleaned.groupBy("doc_id", "field").agg(F.max_by("value", "page_no").alias("value"))


def compared(field: Column, general: Column, crop: Column) -> Column:
    """The choice between two values: the label's if it is valid, else the crop's if that is, with how it came about."""
    g, c = T.valid(field, general), T.valid(field, crop)
    return F.struct(
        F.when(g, general).when(c, crop).alias("value"),
        F.when(g, "OCR_GENERAL").when(c, "OCR_CROP").otherwise("NINGUNO").alias("origen"),
        g.alias("general_valido"), c.alias("crop_valido"), (g & c & (T.normalize(general) == T.normalize(crop))).alias("coinciden"),
    )


def compare(general: DataFrame, crop: DataFrame) -> DataFrame:
    """(doc_id, field, general, crop, and the fields of `compared`) for every field that either side has."""
    g = general.select("doc_id", "field", F.col("value").alias("general"))
    c = crop.select("doc_id", "field", F.col("value").alias("crop"))
    both = g.join(c, ["doc_id", "field"], "full_outer")
    return both.withColumn("r", compared(F.col("field"), F.col("general"), F.col("crop"))).select("doc_id", "field", "general", "crop", "r.*")


def _judged(candidates: DataFrame) -> DataFrame:
    """The candidates, crops after cleaning, with `ok`, whether they are valid.

    Each step is a column of its own, computed once. Groups are filtered by their outcome and not rows by `ok`: a filter
    would move down to the candidates and compute the steps anew in each of its places.
    """
    f, v = F.col("field"), F.col("value")
    x = candidates.select("doc_id", "field", "source", "page_no", F.when(F.col("source") == "crop", T.cleaned(f, v)).otherwise(v).alias("value"))
    return x.withColumn("_v", T.strip(v)).withColumn("ok", T.valid_stripped(f, F.col("_v"))).drop("_v")


def merged(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, text, general, crop): the outcomes of the three merges side by side, null for none, from one pass over all candidates (with `source`)."""
    page = lambda name: F.when(F.col("ok") & (F.col("source") == name), F.col("page_no"))
    return _judged(candidates).groupBy("doc_id", "field").agg(
        F.min_by("value", page("text")).alias("text"), F.max_by("value", page("general")).alias("general"), F.max_by("value", page("crop")).alias("crop"), F.bool_or("ok").alias("_any"),
    ).filter("_any").drop("_any")


def _ranked(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, value, ok, rank) of the candidates; the valid one of the largest rank counts: label over crop over embedded text, the latest page, of embedded text the earliest."""
    of, page = F.col("source"), F.col("page_no").cast("long")
    rank = F.when(of == "general", page + (2 << 33)).when(of == "crop", page + (1 << 33)).when(of == "text", -page)
    return _judged(candidates).select("doc_id", "field", "value", "ok", F.when(F.col("ok"), rank).alias("rank"))


def precedence(candidates: DataFrame) -> DataFrame:
    """(doc_id, field, value): label over crop over embedded text; what is merged is valid already."""
    best = _ranked(candidates).groupBy("doc_id", "field").agg(F.max_by("value", "rank").alias("value"), F.bool_or("ok").alias("_any"))
    return best.filter("_any").drop("_any")


def wide_precedence(candidates: DataFrame, fields: tuple[str, ...] = T.FIELDS) -> DataFrame:
    """`wide` of `precedence`, in one grouping by document."""
    best = [T.final(F.max_by("value", F.when(F.col("field") == f, F.col("rank")))).alias(f) for f in fields]
    return _ranked(candidates).groupBy("doc_id").agg(*best, F.bool_or("ok").alias("_any")).filter("_any").drop("_any")


def rebuild_name(final: DataFrame, crop: DataFrame) -> DataFrame:
    """`final` with nombre_completo from the crop's surnames and names where it has both."""
    part = lambda f: F.max(F.when(F.col("field") == f, T.some(F.col("value"))))
    full = crop.groupBy("doc_id").agg(part("apellidos").alias("a"), part("nombres").alias("n")).filter("a IS NOT NULL AND n IS NOT NULL")
    name = full.select("doc_id", F.lit("nombre_completo").alias("field"), T.clean_text(F.concat_ws(" ", "a", "n")).alias("name"))
    name = name.filter(T.valid(F.col("field"), F.col("name")))
    return final.join(name, ["doc_id", "field"], "full_outer").select("doc_id", "field", F.coalesce("name", "value").alias("value"))


def combine(zones: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, field, value, origen): the candidate of more points, the zone's on a tie, and a value rather than none."""
    z = zones.select("doc_id", "field", F.col("value").alias("z"))
    e = labels.select("doc_id", "field", F.col("value").alias("e"))
    both = z.join(e, ["doc_id", "field"], "full_outer")
    more = T.score(F.col("field"), F.col("e"), F.lit("etiqueta")) > T.score(F.col("field"), F.col("z"), F.lit("coordenadas"))
    has_z, has_e = T.some(F.col("z")).isNotNull(), T.some(F.col("e")).isNotNull()
    label = F.when(~has_z & has_e, True).when(~has_e & has_z, False).otherwise(more)
    return both.select("doc_id", "field", F.when(label, F.col("e")).otherwise(F.col("z")).alias("value"), F.when(label, "ETIQUETA").otherwise("COORDENADAS").alias("origen"))


def wide(final: DataFrame, fields: tuple[str, ...] = T.FIELDS) -> DataFrame:
    """One row a document with a trimmed column for every field, empty where there is no value."""
    columns = [T.final(F.max(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in fields]
    return final.groupBy("doc_id").agg(*columns)


def envelope(text: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, resultado, metodo, error): the text path's fields if at least two of five are there, else the OCR path's, else an error.

    `text` is `extract_by_lines`, `ocr` is `wide`; a document may be missing from either.
    """
    t_names, o_names = ([c for c in df.columns if c != "doc_id"] for df in (text, ocr))
    useful = T.useful(*(F.col(c) for c in ("numero_documento", "nombre_completo", "fecha_nacimiento", "sexo", "rh")))
    t = text.select("doc_id", useful.alias("ok"), *(F.col(c).cast("string").alias(f"t_{c}") for c in t_names))
    o = ocr.select("doc_id", F.lit(True).alias("read"), *(F.col(c).cast("string").alias(f"o_{c}") for c in o_names))
    # Maps are made after the join, of the path that was taken; before it they would travel with their keys.
    as_map = lambda side, cols: F.map_filter(F.create_map(*(x for c in cols for x in (F.lit(c), F.col(f"{side}_{c}")))), lambda _, v: v.isNotNull())
    ok, read = F.coalesce("ok", F.lit(False)), F.col("read").isNotNull()
    return t.join(o, "doc_id", "full_outer").select(
        "doc_id", F.when(ok, as_map("t", t_names)).when(read, as_map("o", o_names)).alias("resultado"),
        F.when(ok, "pdf_texto").when(read, "ocr_template").alias("metodo"),
        F.when(~ok & ~read, "El documento no se pudo leer correctamente.").alias("error"),
    )

"""Paths of landed files and the addresses of what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def landing_path(root: str, program: Column, user_id: Column, arrived: Column, name: Column) -> Column:
    """Where an upload lands: a folder for the programme and a name from user, time and file name; null without a programme."""
    stamp = F.concat_ws("_", user_id.cast("string"), F.date_format(arrived, "yyyyMMdd_HHmmss"), name)
    return F.when(program.isNotNull(), F.concat_ws("/", F.lit(root.rstrip("/")), F.replace(program, F.lit(" "), F.lit("_")), stamp))


def crop_name(page: Column, field: Column) -> Column:
    """The file name of a zone's image."""
    return F.concat(F.lit("pagina_"), F.lpad(page.cast("string"), 2, "0"), F.lit("_"), field, F.lit(".png"))


def crop_url(base: str, path: Column, marker: str = "/documentos/") -> Column:
    """The public address of a file: what follows the first marker; null without a base or outside the marked folder."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    at = F.instr(plain, marker)
    rest = F.substring(plain, at + len(marker), F.length(plain))
    return F.when(F.lit(bool(base)) & (at > 0), F.concat(F.lit(f"{base.rstrip('/')}/ocr/debug/"), rest))


def safe_path(name: Column) -> Column:
    """A requested file name with plain slashes and without a leading debug folder; null if it climbs out of its folder."""
    plain = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^/*(ocr_debug/)*", "")
    return F.when(~plain.rlike(r"(^|/)\.\.(/|$)") & (plain != ""), plain)

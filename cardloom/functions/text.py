"""Scalar functions over text, dates and fields, as built-in column expressions.

An empty string counts as no value wherever a decision is taken. Where two behaviours of a function exist, the
strict one is the default and the others are options or functions of their own.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month abbreviations in order, and the English ones that dates may use as well.
MONTHS = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC")
ENGLISH_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
FIELDS = ("numero_documento", "apellidos", "nombres", "nombre_completo", "fecha_nacimiento", "sexo", "lugar_nacimiento", "nacionalidad", "tipo_sangre")
NAME_FIELDS, PLACE_FIELDS = ("apellidos", "nombres", "nombre_completo"), ("lugar_nacimiento", "nacionalidad")
_LETTERS = "A-Za-zÁÉÍÓÚÑáéíóúñ"
_BLOOD = "(AB|A|B|O)[+-]"
# White space of any kind.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _folds() -> tuple[str, str]:
    """Precomposed characters below U+3000 that decompose to a kept ASCII character and marks, and those characters."""
    pairs = []
    for p in range(0x80, 0x3000):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(p)) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != chr(p) and bare in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+#.":
            pairs.append((chr(p), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def some(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` uses it; keeps generated code small."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(_WHITE))


def match(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return some(F.regexp_extract(c, pattern, group))


def normalize(c: Column) -> Column:
    """Upper case, accents dropped, everything but A-Z 0-9 + # . to single spaces; null to the empty string."""
    plain = F.regexp_replace(F.translate(F.upper(F.coalesce(c, F.lit(""))), _FROM, _TO), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(plain, "[^A-Z0-9+#.]+", " "))


def upper_plain(c: Column) -> Column:
    """Upper case after upper-case accents are dropped: lower-case accented vowels keep theirs."""
    return F.upper(F.translate(c, "ÁÉÍÓÚ", "AEIOU"))


def digits(c: Column, empty: bool = False) -> Column:
    """The digits only; none is null, or the empty string with `empty`."""
    found = some(F.regexp_replace(c, r"\D", ""))
    return F.coalesce(found, F.lit("")) if empty else found


def clean_text(c: Column, empty: bool = False) -> Column:
    """Letters and single spaces in title case; nothing left is null, or the empty string with `empty`."""
    kept = F.regexp_replace(F.regexp_replace(c, rf"(?U)[^{_LETTERS}\s]", ""), r"(?U)\s+", " ")
    found = some(F.initcap(F.trim(kept)))
    return F.coalesce(found, F.lit("")) if empty else found


def clean_text_upper(c: Column) -> Column:
    """ASCII letters, upper-case accented ones and spaces as they are, trimmed; an empty input is null."""
    return F.when(some(c).isNotNull(), F.trim(F.regexp_replace(c, "[^A-Za-zÁÉÍÓÚÑ ]", "")))


def _month(name: Column, english: bool = False) -> Column:
    """The number of a month by its name, in two digits; one lookup, so that the name is computed once."""
    table = dict(zip(MONTHS + (ENGLISH_MONTHS if english else ()), (*range(1, 13), *range(1, 13)), strict=False))
    return F.try_element_at(F.create_map(*(F.lit(x) for text, number in table.items() for x in (text, f"{number:02d}"))), name)


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date of digit strings, null if there is no such day."""
    real = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & (year != "0000"), F.try_to_date(real, "yyyy-MM-dd"))


def parse_date(c: Column) -> Column:
    """An ISO date from the first D-MMM-YYYY with a Spanish month, else the first D-M-YYYY; null for none or no such day."""
    return let(F.upper(strip(c)), _parsed)


def _parsed(raw: Column) -> Column:
    named = r"(?U)(\d{1,2})[-/\s]([A-ZÁÉÍÓÚ]{3})[-/\s](\d{4})"
    plain = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
    month = _month(F.regexp_extract(raw, named, 2))
    by_name = _date(match(raw, named, 3), month, match(raw, named, 1))
    by_number = _date(match(raw, plain, 3), match(raw, plain, 2), match(raw, plain, 1))
    return F.date_format(F.when(month.isNotNull(), by_name).otherwise(by_number), "yyyy-MM-dd")


def parse_date_lenient(c: Column) -> Column:
    """D-MMM-YYYY at the beginning as ISO without a calendar check, unknown months as 01; else the trimmed input; null as empty."""
    pattern = r"(?U)^(\d{1,2})[-\s]([A-ZÁÉÍÓÚ]{3})[-\s](\d{4})"
    up = F.upper(c)
    month = F.coalesce(_month(F.regexp_extract(up, pattern, 2)), F.lit("01"))
    iso = F.concat_ws("-", match(up, pattern, 3), month, F.lpad(match(up, pattern, 1), 2, "0"))
    return F.coalesce(F.when(match(up, pattern).isNotNull(), iso).otherwise(strip(c)), F.lit(""))


def find_date(c: Column) -> Column:
    """The first DD-AAA-YYYY (or with slashes) or DD/DD/YYYY as it stands."""
    return match(c, r"\d{2}[-/][A-Za-z]{3}[-/]\d{4}|\d{2}/\d{2}/\d{4}")


def sex(c: Column, empty: bool = False) -> Column:
    """Masculino or Femenino by the first letter; else null, or the empty string with `empty`."""
    up = F.upper(strip(c))
    out = F.when(up.startswith("M"), "Masculino").when(up.startswith("F"), "Femenino")
    return F.coalesce(out, F.lit("")) if empty else out


def blood(c: Column) -> Column:
    """The first blood type, with zeros read as O and spaces left out."""
    return match(F.replace(F.replace(F.upper(c), F.lit(" "), F.lit("")), F.lit("0"), F.lit("O")), _BLOOD)


def blood_prefix(c: Column) -> Column:
    """One or two of A, B, O and a sign at the beginning; else the empty string."""
    return F.coalesce(F.regexp_extract(F.upper(c), "^([ABO]{1,2}[+-])", 1), F.lit(""))


def valid(field: Column, value: Column) -> Column:
    """Whether a field's value is plausible; false for null or blank values."""
    return valid_stripped(field, strip(value))


def valid_stripped(field: Column, v: Column) -> Column:
    """`valid` of a value without white space at its ends, best a column of its own, since it is used in many places."""
    long = (F.length(v) >= 3) & (F.length(F.replace(v, F.lit(" "), F.lit(""))) >= 3)
    iso = F.try_to_date(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (F.substring(v, 1, 4) != "0000"), v), "yyyy-MM-dd").isNotNull()
    ok = (
        F.when(field == "numero_documento", v.rlike(r"^\d{6,12}\z"))
        .when(field == "fecha_nacimiento", iso)
        .when(field == "sexo", v.isin("Masculino", "Femenino"))
        .when(field == "tipo_sangre", v.rlike(rf"^{_BLOOD}\z"))
        .when(field.isin(*NAME_FIELDS, *PLACE_FIELDS), long)
        .otherwise(F.lit(True))
    )
    return F.coalesce(some(v).isNotNull() & ok, F.lit(False))


def clean_field(field: Column, value: Column) -> Column:
    """The field's cleaner applied, null unless the outcome is valid."""
    return let(cleaned(field, value), lambda v: F.when(valid(field, v), v))


def cleaned(field: Column, value: Column) -> Column:
    """The field's cleaner applied, valid or not."""
    return (
        F.when(field == "numero_documento", digits(value))
        .when(field == "fecha_nacimiento", parse_date(value))
        .when(field == "sexo", sex(value))
        .when(field == "tipo_sangre", blood(value))
        .otherwise(clean_text(value))
    )


def age(c: Column, as_of: Column) -> Column:
    """Whole years from a D-MMM-YYYY or D MMM YYYY date (Spanish or English month) to a day; null if it is no such date."""
    dashed = F.replace(c, F.lit(","), F.lit(""))
    three = F.size(F.split(dashed, "-")) == 3
    by_dash = F.when(dashed.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}\z"), F.split(dashed, "-"))
    by_space = F.when(c.rlike(r"^\s*\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s*\z"), F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    born = let(F.when(three, by_dash).otherwise(by_space), lambda p: _date(F.get(p, F.lit(2)), _month(F.upper(F.get(p, F.lit(1))), english=True), F.get(p, F.lit(0))))
    day = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    return let(born, lambda b: F.year(as_of) - F.year(b) - (day(as_of) < day(b)).cast("int"))


def document_type(number: Column) -> Column:
    """The kind of document by its number's form; null counts as empty. The third form is covered by the first two."""
    n = F.coalesce(number, F.lit(""))
    return (
        F.when(n.rlike(r"^\d{8,10}$"), "colombia_cedula")
        .when(n.rlike(r"^\d{6,8}$"), "colombia_tarjeta")
        .when(n.rlike(r"^\d{7,9}$"), "venezuela")
        .otherwise("extranjero")
    )


def checks(name: Column, number: Column, sex_: Column, blood_: Column, kind: Column) -> Column:
    """Four booleans of form: nombre_completo, numero_documento, sexo, tipo_sangre."""
    e = lambda c: F.coalesce(c, F.lit(""))
    n = e(number)
    by_kind = (
        F.when(kind == "colombia_cedula", n.rlike(r"^\d{8,10}$"))
        .when(kind == "colombia_tarjeta", n.rlike(r"^\d{6,8}$"))
        .when(kind == "venezuela", n.rlike(r"^\d{7,9}$"))
        .otherwise(n.rlike(r"^\d{6,12}$"))
    )
    return F.struct(
        e(name).rlike("^[A-Za-zÁÉÍÓÚÑ ]+$").alias("nombre_completo"), by_kind.alias("numero_documento"),
        F.upper(e(sex_)).isin("M", "F").alias("sexo"), e(blood_).rlike("^(A|B|O)[+-]$").alias("tipo_sangre"),
    )


def filled(*columns: Column) -> Column:
    """How many of the columns have a value."""
    return sum((some(c).isNotNull().cast("int") for c in columns), F.lit(0))


def useful(*columns: Column) -> Column:
    """Whether at least two of the columns have a value."""
    return filled(*columns) >= 2


def final(c: Column) -> Column:
    """A value for output: trimmed, null as empty."""
    return F.coalesce(strip(c), F.lit(""))


def score(field: Column, value: Column, origin: Column) -> Column:
    """Points of a candidate value: none if invalid, else by origin, form and field."""
    v = strip(value)
    words = F.size(F.filter(F.split(v, r"(?U)\s+"), lambda w: w != ""))
    points = (
        F.lit(50)
        + F.when(origin == "etiqueta", 10).otherwise(0)
        + F.when((field == "numero_documento") & value.rlike(r"^\d{8,10}\z"), 25)
        .when(field.isin("apellidos", "nombres") & (words >= 2), 20)
        .when(field.isin("tipo_sangre", "sexo", "fecha_nacimiento"), 30)
        .otherwise(0)
    )
    return F.when(valid(field, value), points).otherwise(0)


def similarity_case(a: Column, b: Column) -> Column:
    """The similarity of two normalised texts where no alignment is needed: 0 for an empty one, 1 if equal, 0.95 if one contains the other; else null."""
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.95)
        .cast("double")
    )

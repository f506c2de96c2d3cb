"""Field extraction from page texts: ordered lines with look-behind, look-ahead and last-write-wins folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import text as T

# Line ends, and what marks a heading line.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
HEADINGS = ("REPUBLICA", "REPUBLICA DE COLOMBIA", "COLOMBIA", "IDENTIFICACION", "IDENTIFICACIÓN", "IDENTIFICACIÓN PERSONAL", "CEDULA DE CIUDADANÍA", "CEDULA DE CIUDADANIA", "CEDULA")
TEXT_FIELDS = ("nombre_completo", "numero_documento", "fecha_nacimiento", "sexo", "lugar_nacimiento", "fecha_expedicion", "nacionalidad", "rh")


def _ended(parts: Column) -> Column:
    """The lines among the parts between line ends: an empty last part is none."""
    return F.slice(parts, 1, F.size(parts) - (F.element_at(parts, -1) == "").cast("int"))


def explode_lines(pages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, raw) from 0; an empty rest after the last line end is no line, and null or empty texts have none."""
    parts = pages.filter(F.col(text_col) != "").select(F.col(id_col).alias("doc_id"), F.split(F.col(text_col), LINE_ENDS).alias("_parts"))
    return parts.select("doc_id", F.posexplode(_ended(F.col("_parts"))).alias("line_no", "raw"))


def _is_heading(plain: Column) -> Column:
    heading = F.lit(False)
    # A heading that contains another one adds nothing.
    for h in (h for h in HEADINGS if not any(o != h and o in h for o in HEADINGS)):
        heading = heading | F.contains(plain, F.lit(h))
    return heading


def _headings_end(raw: Column) -> Column:
    """How many lines at the top of a document are headings, three at most."""
    heading = _is_heading(T.upper_plain(T.strip(raw)))
    whole = Window.partitionBy("doc_id")
    first_other = F.min(F.when(~heading, F.col("line_no"))).over(whole)
    return F.least(F.lit(3), F.coalesce(first_other, F.max("line_no").over(whole) + 1))


def trim_headings(lines: DataFrame) -> DataFrame:
    """Drops up to three heading lines at the top and numbers the rest from 0."""
    return lines.withColumn("_drop", _headings_end(F.col("raw"))).filter("line_no >= _drop").select("doc_id", (F.col("line_no") - F.col("_drop")).alias("line_no"), "raw")


def with_context(lines: DataFrame) -> DataFrame:
    """Adds to each line: `plain`, the two lines before and the one after, and the document's `kind` so far."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    plain = T.upper_plain(T.strip(F.col("raw")))
    event = _event(F.col("plain"))
    so_far = F.last("event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        lines.withColumn("plain", plain)
        .withColumn("event", event)
        .select(
            "doc_id", "line_no", "raw", "plain",
            T.strip(F.lag("raw", 1).over(w)).alias("before"), T.strip(F.lag("raw", 2).over(w)).alias("before2"), T.strip(F.lead("raw", 1).over(w)).alias("after"),
            F.coalesce(so_far, F.lit("desconocido")).alias("kind"),
        )
    )


def _event(plain: Column) -> Column:
    """The kind of document that a line tells, null for none."""
    return F.when(F.contains(plain, F.lit("APELLIDO")) | F.contains(plain, F.lit("NOMBRE")), "antigua").when(F.contains(plain, F.lit("NUIP")), "nueva")


def writes(lines: DataFrame) -> dict[str, Column]:
    """What a line of `with_context` assigns to each field, null for nothing; an empty string is an assignment."""
    return _assigned(*(F.col(c) for c in ("plain", "before", "before2", "after", "kind")))


def _assigned(p: Column, before: Column, before2: Column, after: Column, kind: Column) -> dict[str, Column]:
    has = lambda s: F.contains(p, F.lit(s))
    last_name = F.when(has("APELLIDO"), before)
    first_name = F.when(has("NOMBRE"), before)
    name = T.strip(F.concat(F.coalesce(first_name, F.lit("")), F.lit(" "), F.coalesce(last_name, F.lit(""))))
    short_blood = r"\b[OAB][+-]\b"
    rh_before = F.when(has("RH") & before.isNotNull(), T.match(before, short_blood))
    rh_whole = F.when((kind == "nueva") & p.rlike(short_blood), T.strip(p))
    up = F.upper(after)
    return {
        "numero_documento": F.when(has("NUMERO") | has("NUMER0") | has("NUIP"), F.regexp_replace(after, r"\D", "")),
        "fecha_nacimiento": F.when(has("FECHA DE NACIMIENTO"), after),
        "lugar_nacimiento": F.when(has("LUGAR DE NACIMIENTO"), F.replace(F.concat(before2, F.lit(" "), before), F.lit("!"), F.lit("P"))),
        "sexo": F.when(has("SEXO"), F.when(up.startswith("M"), "Masculino").when(up.startswith("F"), "Femenino")),
        "fecha_expedicion": F.when(has("EXPEDICION"), before),
        "nombre_completo": F.when((has("APELLIDO") | has("NOMBRE")) & (kind == "antigua") & (T.some(first_name).isNotNull() | T.some(last_name).isNotNull()), name),
        "rh": F.coalesce(rh_whole, rh_before),
        "nacionalidad": F.when(has("NACIONALIDAD") & (kind == "nueva"), after),
    }


def fold(lines: DataFrame) -> DataFrame:
    """One row a document of `with_context` with the last assignment to each field."""
    folds = [F.max_by(v, F.when(v.isNotNull(), F.col("line_no"))).alias(k) for k, v in writes(lines).items()]
    return lines.groupBy("doc_id").agg(*folds)


def _folded(stripped: Column, plain: Column) -> Column:
    """What `fold` gives for the lines of one text, two arrays of the lines without headings: a struct of the fields, and `kind`."""
    context = F.transform(plain, lambda p, i: F.struct(p.alias("plain"), *(F.get(stripped, i + d).alias(n) for n, d in (("before", -1), ("before2", -2), ("after", 1)))))

    def step(so_far: Column, x: Column) -> Column:
        kind = F.coalesce(_event(x["plain"]), so_far["kind"])
        found = _assigned(x["plain"], x["before"], x["before2"], x["after"], kind)
        return F.struct(kind.alias("kind"), *(F.coalesce(found[f], so_far[f]).alias(f) for f in TEXT_FIELDS))

    none = F.struct(F.lit("desconocido").alias("kind"), *(F.lit(None).cast("string").alias(f) for f in TEXT_FIELDS))
    return F.aggregate(context, none, step)


def _body(plain: Column) -> Column:
    """The number, from 1, of the first line below up to three headings."""
    other = lambda i: (F.size(plain) > i) & ~_is_heading(F.get(plain, F.lit(i)))
    return F.when(other(0), 1).when(other(1), 2).when(other(2), 3).otherwise(4)


def longest_number(text: Column) -> Column:
    """The longest run of eight to ten digits, the first of equals."""
    found = F.regexp_extract_all(text, F.lit(r"\d{8,10}"), F.lit(0))
    longest = F.array_max(F.transform(found, F.length))
    return F.get(F.filter(found, lambda x: F.length(x) == longest), F.lit(0))


def capital_name(text: Column) -> Column:
    """The first run of two to four upper-case words of three letters or more that names no heading, in title case."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)[A-ZÁÉÍÓÚÑ]{3,}(?:\s+[A-ZÁÉÍÓÚÑ]{3,}){1,3}"), F.lit(0))
    kept = F.filter(found, lambda x: ~F.contains(x, F.lit("COLOMBIA")) & ~F.contains(x, F.lit("IDENTIFICACION")))
    # Title case breaks words at any white space, which stays as it is.
    parts = F.regexp_extract_all(F.get(kept, F.lit(0)), F.lit(r"(?U)\s+|\S+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.initcap(x)), "")


def extract_by_lines(pages: DataFrame, as_of: Column, *, id_col: str = "doc_id", text_col: str = "text", wider: bool = False) -> DataFrame:
    """One row a text with the fields of `TEXT_FIELDS` and `edad`, null where the lines say nothing.

    Of several assignments the last one wins. The number and the name have fallbacks over the whole text, and with
    `wider` the blood type, the birth date and the sex as well. Ages count to `as_of`. Rows without a text keep nulls;
    ids are expected to be unique.
    """
    t = F.col("_text")
    fallback = {"numero_documento": longest_number(t), "nombre_completo": T.some(capital_name(t))}
    if wider:
        fallback |= {
            "rh": T.match(t, r"(?U)\b[OAB][+-]\b"), "fecha_nacimiento": T.match(t, r"\d{2}-[A-Z]{3}-\d{4}"),
            "sexo": F.when(t.rlike(r"(?U)\bM\b"), "Masculino").when(t.rlike(r"(?U)\bF\b"), "Femenino"),
        }
    # A text's lines stay in its row: nothing is shuffled, and the whole text is searched only for what its lines don't say.
    # Each step is a column, since what is used in several places would be computed in each of them.
    x = pages.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.split(F.col(text_col), LINE_ENDS).alias("_parts"))
    x = x.select("doc_id", "_text", F.transform(_ended(F.col("_parts")), T.strip).alias("_stripped"))
    x = x.withColumn("_plain", F.transform("_stripped", T.upper_plain)).withColumn("_body", _body(F.col("_plain")))
    x = x.select("doc_id", "_text", *(F.slice(c, F.col("_body"), F.lit(1 << 30)).alias(c) for c in ("_stripped", "_plain")))
    found = x.select("doc_id", "_text", _folded(F.col("_stripped"), F.col("_plain")).alias("_f")).select("doc_id", "_text", "_f.*")
    found = found.withColumns({c: F.coalesce(T.some(F.col(c)), v, c) for c, v in fallback.items()})
    return found.select(
        "doc_id", "nombre_completo", "numero_documento", "fecha_nacimiento", "sexo",
        "lugar_nacimiento", "fecha_expedicion", "nacionalidad", "rh", T.age(F.col("fecha_nacimiento"), as_of).alias("edad"),
    )


# Fixed values from here on: the patterns of fields in whole texts.
_NAME = r"([A-ZÁÉÍÓÚÑ\s]+)"


def regex_fields(text: Column) -> dict[str, Column]:
    """The fields that patterns find in a whole text, cleaned; null where there is none."""
    i = "(?iuU)"
    hit = lambda p, g: T.match(text, i + p, g)
    return {
        "numero_documento": T.match(text, r"\b(\d{6,15})\b", 1),
        "nombre_completo": T.clean_text(hit(rf"(?:NOMBRE|NOMBRES?)\s*:?\s*{_NAME}", 1)),
        "fecha_nacimiento": T.let(T.match(text, r"(?U)(\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{4})", 1), T.parse_date),
        "sexo": T.sex(hit(r"(SEXO|GENERO)\s*:?\s*([MF])", 2)),
        "lugar_nacimiento": T.clean_text(hit(rf"(?:LUGAR|CIUDAD)\s*(?:DE)?\s*NACIMIENTO\s*:?\s*{_NAME}", 1)),
        "nacionalidad": T.clean_text(hit(rf"(NACIONALIDAD)\s*:?\s*{_NAME}", 2)),
        "tipo_sangre": T.blood(hit(r"(TIPO\s*(?:DE)?\s*SANGRE|RH)\s*:?\s*([A-Z0-9+-]+)", 2)),
    }


def extract_by_patterns(pages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a text with the fields of `regex_fields`; `keep` names further columns to carry along."""
    return pages.select(F.col(id_col).alias("doc_id"), *keep, *(v.alias(k) for k, v in regex_fields(F.col(text_col)).items()))


def extract_hybrid(pages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", layout_col: str | None = None) -> DataFrame:
    """The whole-text variant: fields by pattern with empty strings for none; without a number, number, date, blood and sex come from `layout_col` instead."""
    t = F.col(text_col)
    e = lambda c: F.coalesce(c, F.lit(""))
    blood = r"(O|A|B|AB)[+-]"

    def digital(x: Column, up: bool) -> dict[str, Column]:
        return {
            "numero_documento": T.digits(T.match(x, r"\d{6,15}"), empty=True),
            "fecha_nacimiento": T.parse_date_lenient(T.match(x, r"\d{2}-[A-Z]{3}-\d{4}")),
            "tipo_sangre": T.blood_prefix(T.match(x, blood)),
            "sexo": T.sex(T.match(F.upper(x) if up else x, r"(?U)\b(M|F)\b"), empty=True),
        }

    after = lambda label, extra="": T.clean_text(T.match(t, rf"(?iuU){label}\s*\n([A-ZÁÉÍÓÚÑ\s{extra}]+)", 1), empty=True)
    base = digital(t, True)
    if layout_col:
        blank = base["numero_documento"] == ""
        base = {k: F.when(blank, e(v)).otherwise(base[k]) for k, v in digital(F.col(layout_col), False).items()}
    last, first = after("APELLIDOS"), after("NOMBRES")
    return pages.select(
        F.col(id_col).alias("doc_id"), *(e(v).alias(k) for k, v in base.items()), last.alias("apellidos"), first.alias("nombres"),
        F.trim(F.concat(first, F.lit(" "), last)).alias("nombre_completo"),
        after("LUGAR DE NACIMIENTO", r"\(\)").alias("lugar_nacimiento"), after("NACIONALIDAD").alias("nacionalidad"),
    )

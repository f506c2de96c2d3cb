"""Spatial layout: word boxes to lines, labels to lines, and values next to labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.functions.similar import page_reader

# Label variants of each field, zones of each template, and what tells a card's side.
LABELS = {
    "numero_documento": ("NUMERO", "NÚMERO", "NUM", "NUM.", "NUMERO DE DOCUMENTO", "DOCUMENTO", "IDENTIFICACION", "IDENTIFICACIÓN"),
    "apellidos": ("APELLIDOS", "APELLIDO", "APEL"),
    "nombres": ("NOMBRES", "NOMBRE", "NOMB", "NOM"),
    "fecha_nacimiento": ("FECHA DE NACIMIENTO", "FECHA DE NACIMIENTO:", "FECHA NACIMIENTO", "NACIMIENTO"),
    "lugar_nacimiento": ("LUGAR DE NACIMIENTO", "LUGAR DE NACIMIETO", "LUGAR NACIMIENTO", "LUGAR"),
    "nacionalidad": ("NACIONALIDAD", "NACIONAL"),
    "tipo_sangre": ("G.S. RH", "G. S. RH", "GS RH", "G S RH", "RH", "TIPO DE SANGRE"),
    "sexo": ("SEXO",),
    "estatura": ("ESTATURA",),
    "fecha_expedicion": ("FECHA Y LUGAR DE EXPEDICION", "FECHA Y LUGAR DE EXPEDICIÓN", "FECHA EXPEDICION", "FECHA EXPEDICIÓN"),
}
ZONES = {
    "anverso": {"numero_documento": (0.04, 0.26, 0.85, 0.36), "apellidos": (0.04, 0.34, 0.50, 0.44), "nombres": (0.04, 0.46, 0.99, 0.60)},
    "reverso": {"fecha_nacimiento": (0.45, 0.07, 0.72, 0.14), "lugar_nacimiento": (0.10, 0.07, 0.42, 0.16), "tipo_sangre": (0.48, 0.16, 0.62, 0.23), "sexo": (0.68, 0.16, 0.78, 0.23)},
    "digital": {
        "numero_documento": (0.65, 0.08, 0.95, 0.13), "nombre_completo": (0.15, 0.25, 0.85, 0.32), "fecha_nacimiento": (0.15, 0.35, 0.40, 0.40), "sexo": (0.45, 0.35, 0.55, 0.40),
        "lugar_nacimiento": (0.15, 0.45, 0.55, 0.50), "nacionalidad": (0.60, 0.45, 0.85, 0.50), "tipo_sangre": (0.75, 0.55, 0.95, 0.60),
    },
}
FRONT_LABELS = ("NUMERO", "NÚMERO", "APELLIDOS", "NOMBRES")
BACK_LABELS = ("FECHA DE NACIMIENTO", "LUGAR DE NACIMIENTO", "NACIONALIDAD", "ESTATURA", "SEXO", "RH", "G.S. RH", "FECHA Y LUGAR DE EXPEDICION")
SIDE_FIELDS = {"anverso": ("numero_documento", "apellidos", "nombres"), "reverso": ("fecha_nacimiento", "lugar_nacimiento", "nacionalidad", "tipo_sangre", "sexo")}
SIDE_FIELDS["desconocido"] = SIDE_FIELDS["anverso"] + SIDE_FIELDS["reverso"]
#: Least confidence of a word; tolerance of a line in pixels and in heights; thresholds of similarity.
CONFIDENCE, TOLERANCE_PX, TOLERANCE_HEIGHT = 15.0, 12.0, 0.6
FIND, EXCLUDE, SIDE_WORD, INSIDE = 0.62, 0.75, 0.70, 0.96
CARD_ASPECT = 85.60 / 53.98
#: Least score of a card, least share and aspects of a region, and its padding.
ACCEPT, LEAST_REGION, REGION_ASPECT, PADDING = 0.45, 0.05, (1.10, 2.20), 0.01
PAGE = ["doc_id", "page_no"]


def usable_words(words: DataFrame) -> DataFrame:
    """Words with text and enough confidence, with `norm`, `cx` and `cy`; a missing confidence counts as none."""
    text = T.strip(F.col("text"))
    kept = words.withColumn("text", text).filter((F.col("text") != "") & (F.coalesce("conf", F.lit(0.0)) >= CONFIDENCE))
    return kept.withColumns({"norm": T.normalize(F.col("text")), "cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})


def dedupe_words(words: DataFrame) -> DataFrame:
    """Of words alike in `norm` and in their place to ten pixels, the first by recogniser mode and position."""
    grid = lambda c: F.bround(F.col(c) / 10, 0)
    w = Window.partitionBy(*PAGE, "norm", grid("x"), grid("y")).orderBy("config_ord", "word_ord")
    return words.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cluster_lines(words: DataFrame) -> DataFrame:
    """Adds `line_id`: words by height on the page join the first line whose mean is near enough.

    Each word changes its line's mean and height, so words pass in order of page and height; only the lines of the
    page at hand are held.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines = None, []
        for batch in batches:
            out = []
            for *page, cy, h in zip(*(batch.column(c).to_pylist() for c in (*PAGE, "cy", "h")), strict=True):
                if page != now:
                    now, lines = page, []
                for i, (total, count, height) in enumerate(lines):
                    if abs(cy - total / count) <= max(TOLERANCE_PX, max(height, h) * TOLERANCE_HEIGHT):
                        lines[i] = (total + cy, count + 1, max(height, h))
                        break
                else:
                    i = len(lines)
                    lines.append((cy, 1, h))
                out.append(i)
            yield batch.append_column("line_id", pa.array(out, pa.int32()))

    order = [*PAGE, "cy", "x", "config_ord", "word_ord"]
    return words.repartition(*PAGE).sortWithinPartitions(*order).mapInArrow(run, f"{fields}, line_id int")


def assemble_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, norm, items, x1, y1, x2, y2, cx, cy): lines of words with `line_id`, numbered downwards."""
    item = F.struct("x", "cy", "config_ord", "word_ord", "text", "y", "w", "h", "conf")
    lines = words.groupBy(*PAGE, "line_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.min("x").alias("x1"), F.min("y").alias("y1"),
        F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"),
    )
    text = F.array_join(F.transform("items", lambda i: i["text"]), " ")
    lines = lines.withColumns({"text": text, "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    order = Window.partitionBy(*PAGE).orderBy("cy", "line_id")
    return lines.withColumns({"norm": T.normalize(F.col("text")), "line_no": F.row_number().over(order) - 1}).drop("line_id")


def line_text(items: Column) -> Column:
    """The items' texts from left to right; null as empty."""
    return F.coalesce(T.strip(F.array_join(F.transform(F.array_sort(F.transform(items, lambda i: F.struct(i["x"].alias("x"), i["text"].alias("text")))), lambda i: i["text"]), " ")), F.lit(""))


def neighbours(lines: DataFrame, above: int = 2, below: int = 2) -> DataFrame:
    """Adds `above` and `below`: the texts of up to so many lines before, from the top, and after."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    up = F.collect_list("text").over(w.rowsBetween(-above, -1)) if above else F.array().cast("array<string>")
    down = F.collect_list("text").over(w.rowsBetween(1, below)) if below else F.array().cast("array<string>")
    return lines.withColumns({"above": up, "below": down})


def label_table(spark: SparkSession, labels: dict[str, tuple[str, ...]] = LABELS) -> DataFrame:
    """(field, label_ord, label, label_norm): a dictionary as a small table."""
    rows = [(f, i, x) for f, xs in labels.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "field string, label_ord int, label string").withColumn("label_norm", T.normalize(F.col("label")))


def _pages(lines: DataFrame, *columns: Column, labels: dict[str, tuple[str, ...]] = LABELS, find: float = FIND, exclude: float = EXCLUDE) -> DataFrame:
    """(doc_id, page_no, lines, seen): the lines of each page from the top, as structs of `norm` and `columns`, and what they resemble (see `page_reader`).

    Lines come dealt by page from their numbering, so nothing is shuffled here, and every page is read once.
    """
    read = page_reader(labels, (FRONT_LABELS, BACK_LABELS), find, exclude, SIDE_WORD, INSIDE)
    line = F.struct("line_no", "norm", *columns)
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return pages.withColumn("seen", read(F.transform("lines", lambda l: l["norm"])))


def find_labels(lines: DataFrame, labels: dict[str, tuple[str, ...]] = LABELS, threshold: float = FIND) -> DataFrame:
    """(doc_id, page_no, field, line_no, label, label_norm, score): of each field the line and label most alike, if alike enough.

    A label inside a line counts 0.96. Words of three characters or more are compared too. Ties go to the first line,
    then to the first label.
    """
    found = _pages(lines, labels=labels, find=threshold).select(*PAGE, "lines", F.explode("seen.found").alias("f"))
    return found.select(*PAGE, "f.field", F.get("lines", F.col("f.line"))["line_no"].alias("line_no"), "f.label", "f.label_norm", "f.score")


def resembles_label(lines: DataFrame, labels: dict[str, tuple[str, ...]] = LABELS, threshold: float = EXCLUDE) -> DataFrame:
    """`lines` with `is_label`: whether a line's text contains or resembles any label."""
    rest = [c for c in lines.columns if c not in (*PAGE, "line_no", "norm")]
    pages = _pages(lines, *(F.col(f"`{c}`") for c in rest), labels=labels, exclude=threshold)
    out = pages.select(*PAGE, F.explode(F.arrays_zip("lines", F.col("seen.is_label").alias("is_label"))).alias("z")).select(*PAGE, "z.lines.*", "z.is_label")
    return out.select(*(F.col(f"`{c}`") for c in lines.columns), "is_label")


def _side(front: Column, back: Column) -> Column:
    return F.when(front > back, "anverso").when(back > front, "reverso").otherwise("desconocido")


def detect_side(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, front, back, lado): a label inside the page counts two, a word like it one; more points win."""
    return _pages(lines).select(*PAGE, "seen.front", "seen.back", _side(F.col("seen.front"), F.col("seen.back")).alias("lado"))


def _first(values: Column) -> Column:
    """The first element that isn't null."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _with_letters(lines: DataFrame, **options) -> DataFrame:
    letters = F.filter(F.transform("items", lambda i: T.normalize(i["text"])), lambda t: t.isin("M", "F"))
    return _pages(lines, F.col("text"), letters.alias("letters"), **options)


def _with_value(x: DataFrame) -> DataFrame:
    """Adds `value`: what the label `hit` (a struct of `found`, or null) of `field` leads to among `lines`, with `seen.is_label`."""
    field, hit, n = F.col("field"), F.col("hit"), F.coalesce("hit.line", F.lit(0))
    # The lines around the label, each made once: three above from the nearest, its own, two below.
    around = F.slice(F.arrays_zip("lines", F.col("seen.is_label").alias("is_label")), F.greatest(n - 2, F.lit(1)), F.least(n, F.lit(3)) + 3)
    marked = F.transform(around, lambda z: F.struct(z["lines"]["text"].alias("text"), z["lines"]["norm"].alias("norm"), z["lines"]["letters"].alias("letters"), z["is_label"].alias("is_label")))
    x = x.withColumns({"_marked": marked, "_at": F.least(n, F.lit(3)), "_label": F.coalesce("hit.label_norm", F.lit(""))})
    x = x.withColumns({
        "_up": F.reverse(F.slice("_marked", F.lit(1), F.col("_at"))), "_here": F.get("_marked", F.col("_at")),
        "_down": F.slice("_marked", F.col("_at") + 2, F.lit(2)), "_texts": F.transform(F.slice("_marked", F.col("_at") + 1, F.lit(3)), lambda l: l["text"]),
    })
    up, here, down, here_and_below, label_norm = F.col("_up"), F.col("_here"), F.col("_down"), F.col("_texts"), F.col("_label")
    plain = lambda ls: F.filter(ls, lambda l: (l["text"] != "") & ~l["is_label"])
    valid_clean = lambda t: T.let(T.clean_text(t), lambda v: F.when(T.valid(field, v), v))
    above = _first(F.transform(plain(F.slice(up, 1, 2)), lambda l: valid_clean(l["text"])))
    place_lines = F.slice(F.filter(plain(up), lambda l: T.parse_date(l["text"]).isNull()), 1, 2)
    place = valid_clean(F.array_join(F.reverse(F.transform(place_lines, lambda l: l["text"])), " "))
    rest = F.trim(F.replace(here["norm"], label_norm, F.lit("")))
    behind = F.when(F.length(rest) >= 3, valid_clean(rest))
    below = _first(F.transform(plain(down), lambda l: valid_clean(l["text"])))
    letters = here["letters"]
    sex = F.when(F.size(letters) > 0, T.sex(F.element_at(letters, -1))).otherwise(T.sex(F.get(F.flatten(F.transform(down, lambda l: l["letters"])), F.lit(0))))
    value = (
        F.when(field == "numero_documento", _first(F.transform(here_and_below, lambda t: T.match(t, r"\d{6,12}"))))
        .when(field == "fecha_nacimiento", _first(F.transform(here_and_below, T.parse_date)))
        .when(field == "sexo", sex)
        .when(field == "tipo_sangre", _first(F.transform(here_and_below, T.blood)))
        .when(field.isin("apellidos", "nombres"), above)
        .when(field == "lugar_nacimiento", place)
        .when(field == "nacionalidad", F.coalesce(behind, below))
    )
    return x.withColumn("value", F.when(hit.isNotNull(), value)).drop("_marked", "_at", "_label", "_up", "_here", "_down", "_texts")


def extract_by_labels(lines: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, field, value): of each field with a label the value that its place beside the label suggests.

    Numbers, dates, sex and blood type stand on the label's line or up to two below; surnames and names on the nearest
    of two lines above, the birth place on two of three above, the nationality behind the label or below, where no
    line that is a label counts. `fields` (doc_id, page_no, field) limits what is looked for.
    """
    x = _with_letters(lines).select(*PAGE, "lines", "seen", F.explode("seen.found").alias("hit")).withColumn("field", F.col("hit.field"))
    if fields is not None:
        x = x.join(fields.select(*PAGE, "field"), [*PAGE, "field"], "left_semi")
    return _with_value(x).select(*PAGE, "field", "value")


def by_labels(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, lado, field, value): the fields of each page's side, found by label and cleaned; null for none.

    A birth date is found in ISO form, which the cleaner doesn't take, so it comes out null here. A page is read once
    for its side, its labels and its values, with no join.
    """
    wanted = F.create_map(*(x for lado, fs in SIDE_FIELDS.items() for x in (F.lit(lado), F.array(*map(F.lit, fs)))))
    pages = _with_letters(lines).withColumn("lado", _side(F.col("seen.front"), F.col("seen.back")))
    x = pages.select(*PAGE, "lado", "lines", "seen", F.explode(F.element_at(wanted, F.col("lado"))).alias("field"))
    x = x.withColumn("hit", F.get(F.filter("seen.found", lambda f: f["field"] == F.col("field")), F.lit(0)))
    return _with_value(x).select(*PAGE, "lado", "field", T.clean_field(F.col("field"), F.col("value")).alias("value"))


def zone_table(spark: SparkSession) -> DataFrame:
    """(template, field, x1, y1, x2, y2) in shares of the page."""
    rows = [(t, f, *map(float, z)) for t, zs in ZONES.items() for f, z in zs.items()]
    return spark.createDataFrame(rows, "template string, field string, x1 double, y1 double, x2 double, y2 double")


def template(model: Column, page_no: Column) -> Column:
    """The template of a page: the digital one, else front for the first page and back for later ones."""
    return F.when(model == "digital", "digital").when(page_no == 1, "anverso").otherwise("reverso")


def zone_boxes(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, template, field, left, top, right, bottom): zones in pixels of pages (modelo, width, height); empty boxes are left out."""
    zones = F.broadcast(zone_table(pages.sparkSession))
    x = pages.withColumn("template", template(F.col("modelo"), F.col("page_no"))).join(zones, "template")
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    pixel = lambda f, a, b, size: (clamp(f(a, b)) * F.col(size)).cast("int")
    boxes = x.select(
        *PAGE, "template", "field", pixel(F.least, "x1", "x2", "width").alias("left"), pixel(F.least, "y1", "y2", "height").alias("top"),
        pixel(F.greatest, "x1", "x2", "width").alias("right"), pixel(F.greatest, "y1", "y2", "height").alias("bottom"),
    )
    return boxes.filter("right > left AND bottom > top")


def zone_values(readings: DataFrame) -> DataFrame:
    """(doc_id, page_no, template, field, value): of every zone the first of its `readings` (an array) with a text, cleaned; null if it has none.

    The readings are a recogniser's, see `sources.recognise.zones`; rows without a field, of files that failed, are left out.
    """
    first = _first(F.transform("readings", lambda r: T.some(T.strip(r))))
    return readings.filter("field IS NOT NULL").select(*PAGE, "template", "field", T.clean_field(F.col("field"), first).alias("value"))


def order_corners(points: Column) -> Column:
    """Corners (arrays x, y) as top left, top right, bottom right, bottom left, by their sums and differences; the first of equals."""
    at = lambda p, i: F.element_at(p, i)

    def pick(key, most: bool) -> Column:
        keyed = F.transform(points, lambda p: key(p).cast("double"))
        goal = F.array_max(keyed) if most else F.array_min(keyed)
        return F.element_at(points, F.array_position(keyed, goal).cast("int"))

    total, diff = (lambda p: at(p, 1) + at(p, 2)), (lambda p: at(p, 2) - at(p, 1))
    return F.array(pick(total, False), pick(diff, False), pick(total, True), pick(diff, True))


def convex(points: Column) -> Column:
    """Whether four points (arrays x, y), in their order, turn the same way at every corner; false for another number of points."""
    at = lambda i, j: F.element_at(F.element_at(points, i % 4 + 1), j)
    turn = lambda i: (at(i + 1, 1) - at(i, 1)) * (at(i + 2, 2) - at(i + 1, 2)) - (at(i + 1, 2) - at(i, 2)) * (at(i + 2, 1) - at(i + 1, 1))
    turns = [turn(i) for i in range(4)]
    every = lambda ok: ok(turns[0]) & ok(turns[1]) & ok(turns[2]) & ok(turns[3])
    return F.when(F.size(points) == 4, every(lambda t: t >= 0) | every(lambda t: t <= 0)).otherwise(False)


def choose_card(images: DataFrame, quads: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, detected, method, score, aspect, corners, box) of every image (doc_id, width, height).

    Of its `quads` (doc_id, ord, area, points) the convex one of the highest `score_card`, the first of equals, if that
    is at least 0.45. Else of its `regions` (doc_id, ord, area, x, y, w, h) the largest of those that fill a twentieth
    of the image and are 1.10 to 2.20 times as wide as high, as a box padded by a hundredth of the shorter side. Else
    the whole image. Scores and aspects are rounded to four places, corners to two.
    """
    size = images.select("doc_id", "width", "height")
    length = lambda a, b: F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2))
    whole = (F.col("width") * F.col("height")).cast("double")
    aspect = lambda c: (length(c[1], c[0]) + length(c[2], c[3])) / (length(c[3], c[0]) + length(c[2], c[1]))
    rated = T.let(order_corners(F.col("points")), lambda c: F.struct(score_card(F.col("area"), c, F.col("width"), F.col("height")).alias("score"), aspect(c).alias("aspect"), c.alias("c")))
    scored = quads.join(size, "doc_id").filter(convex(F.col("points"))).select("doc_id", "ord", rated.alias("q")).filter("q.score IS NOT NULL")
    best = scored.groupBy("doc_id").agg(F.max_by("q", F.struct("q.score", -F.col("ord"))).alias("q"))
    share = F.col("area") / whole
    fit = regions.join(size, "doc_id").filter((share >= LEAST_REGION) & (F.col("w") / F.greatest("h", F.lit(1))).between(*REGION_ASPECT))
    found = fit.groupBy("doc_id").agg(F.max_by(F.struct(F.least(share / 0.5, F.lit(1.0)).alias("score"), "x", "y", "w", "h"), F.struct(F.least(share / 0.5, F.lit(1.0)), -F.col("ord"))).alias("r"))
    pad = (F.least("width", "height") * PADDING).cast("int")
    left, top = F.greatest(F.lit(0), F.col("r.x") - pad), F.greatest(F.lit(0), F.col("r.y") - pad)
    box = F.array(left, top, F.least("width", left + F.col("r.w") + 2 * pad), F.least("height", top + F.col("r.h") + 2 * pad)).cast("array<int>")
    quad, region = F.coalesce(F.col("q.score") >= ACCEPT, F.lit(False)), F.col("r").isNotNull()
    everything = F.array(F.lit(0), F.lit(0), "width", "height").cast("array<int>")
    return size.join(best, "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", (quad | region).alias("detected"),
        F.when(quad, "quadrilateral").when(region, "bounding_box_fallback").otherwise("original_image").alias("method"),
        F.when(quad, F.round("q.score", 4)).when(region, F.round("r.score", 4)).otherwise(0.0).alias("score"),
        F.when(quad, F.round("q.aspect", 4)).alias("aspect"),
        F.when(quad, F.transform("q.c", lambda p: F.transform(p, lambda v: F.round(v, 2)))).alias("corners"),
        F.when(~quad, F.when(region, box).otherwise(everything)).alias("box"),
    )


def score_card(area: Column, corners: Column, width: Column, height: Column) -> Column:
    """How much four ordered corners look like a card on an image of a size; null if too small or out of shape."""
    p = lambda i, j: F.element_at(F.element_at(corners, i), j)
    side = lambda a, b: F.sqrt(F.pow(p(a, 1) - p(b, 1), 2) + F.pow(p(a, 2) - p(b, 2), 2))
    w, h = (side(2, 1) + side(3, 4)) / 2, (side(4, 1) + side(3, 2)) / 2
    aspect = w / F.nullif(h, F.lit(0.0))
    share = area / (width * height)
    error = F.abs(aspect - CARD_ASPECT) / CARD_ASPECT
    one = F.lit(1.0)
    points = F.least(share / 0.25, one) * 0.35 + F.greatest(F.lit(0.0), 1 - error / 0.35) * 0.40 + F.least(area / F.greatest(w * h, one) / 0.90, one) * 0.25
    return F.when((share >= 0.02) & aspect.between(1.15, 2.10), points)

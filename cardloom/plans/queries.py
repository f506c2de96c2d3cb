"""The engine's queries by name: each takes (spark, sf_dir) and applies one operator to a whole synthetic input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.functions.similar import compared_with, plain, similar_pairs
from cardloom.operators import layout, lines, outlines, raster, reconcile, records
from cardloom.plans import fixtures as X
from cardloom.plans.oracles import ORACLES  # noqa: F401
from cardloom.sources import database, files, landing, recognise
from cardloom.streaming import accounts, ingest
from cardloom.streaming.store import Store, shared_folder

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def as_of():
    return F.to_date(F.lit(X.AS_OF))


def arrived():
    return F.to_timestamp_ntz(F.lit(X.ARRIVED))


def _raw(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return X.raw_fields(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in columns.items()))


@query
def t01_normalize(spark, sf_dir):
    return _raw(spark, sf_dir, norm=T.normalize(F.col("text_raw")))


@query
def t02_upper_plain(spark, sf_dir):
    return _raw(spark, sf_dir, plain=T.upper_plain(F.col("text_raw")))


@query
def t03_number(spark, sf_dir):
    return _raw(spark, sf_dir, number=T.digits(F.col("number_raw")), number_or_empty=T.digits(F.col("number_raw"), empty=True))


@query
def t04_text(spark, sf_dir):
    c = F.col("text_raw")
    return _raw(spark, sf_dir, clean=T.clean_text(c), clean_or_empty=T.clean_text(c, empty=True), clean_upper=T.clean_text_upper(c))


@query
def t05_date(spark, sf_dir):
    c = F.col("date_raw")
    return _raw(spark, sf_dir, iso=T.parse_date(c), lenient=T.parse_date_lenient(c), found=T.find_date(c))


@query
def t06_sex(spark, sf_dir):
    return _raw(spark, sf_dir, sex=T.sex(F.col("sex_raw")), sex_or_empty=T.sex(F.col("sex_raw"), empty=True))


@query
def t07_blood(spark, sf_dir):
    return _raw(spark, sf_dir, blood=T.blood(F.col("blood_raw")), blood_prefix=T.blood_prefix(F.col("blood_raw")))


@query
def t08_valid(spark, sf_dir):
    return X.candidates(spark, sf_dir).select("doc_id", "page_no", "field", "source", T.valid(F.col("field"), F.col("value")).alias("ok"))


@query
def t09_clean_field(spark, sf_dir):
    return X.candidates(spark, sf_dir).select("doc_id", "page_no", "field", "source", T.clean_field(F.col("field"), F.col("value")).alias("clean"))


@query
def t10_similarity(spark, sf_dir):
    return compared_with(X.raw_fields(spark, sf_dir).select("doc_id", "text_raw"), "text_raw", [x for xs in layout.LABELS.values() for x in xs])


@query
def t10_similar_pairs(spark, sf_dir):
    """The lines of all pages and their longer words against all labels."""
    norm = F.col("norm")
    pieces = F.array_union(F.array(norm), F.filter(F.split(norm, " "), lambda w: F.length(w) >= 3))
    texts = _lines(spark, sf_dir).select(F.explode(pieces).alias("text"))
    return similar_pairs(texts, [plain(x) for xs in layout.LABELS.values() for x in xs], layout.FIND)


@query
def t11_age(spark, sf_dir):
    return _raw(spark, sf_dir, age=T.age(F.col("date_raw"), as_of()))


@query
def t12_document_type(spark, sf_dir):
    return _raw(spark, sf_dir, kind=T.document_type(F.col("number_raw")))


@query
def t13_checks(spark, sf_dir):
    c = T.checks(F.col("text_raw"), F.col("number_raw"), F.col("sex_raw"), F.col("blood_raw"), F.lit("colombia_cedula"))
    return _raw(spark, sf_dir, name_ok=c["nombre_completo"], number_ok=c["numero_documento"], sex_ok=c["sexo"], blood_ok=c["tipo_sangre"])


@query
def t14_useful(spark, sf_dir):
    five = [F.col(f"{n}_raw") for n in X.RAW]
    return _raw(spark, sf_dir, useful=T.useful(*five), filled=T.filled(*five))


@query
def t14b_useful_seven(spark, sf_dir):
    c, k = {n: F.col(f"{n}_raw") for n in X.RAW}, F.col("doc_id")
    seven = (F.when(k % 2 == 0, c["number"]), F.when(k % 3 == 0, c["text"]), F.when(k % 5 == 0, c["text"]), F.when(k % 7 == 0, c["text"]), F.when(k % 11 == 0, c["date"]), F.when(k % 13 == 0, c["sex"]), F.when(k % 4 == 0, c["blood"]))
    return _raw(spark, sf_dir, useful=T.useful(*seven), filled=T.filled(*seven))


@query
def t15_final(spark, sf_dir):
    return _raw(spark, sf_dir, name=T.final(F.col("text_raw")), number=T.final(F.col("number_raw")))


@query
def t16_score(spark, sf_dir):
    f, v = F.col("field"), F.col("value")
    return X.candidates(spark, sf_dir).select("doc_id", "page_no", "field", "source", T.score(f, v, F.lit("etiqueta")).alias("by_label"), T.score(f, v, F.lit("coordenadas")).alias("by_zone"))


@query
def t17_defaults(spark, sf_dir):
    raw = X.raw_fields(spark, sf_dir)
    x = raw.select("doc_id", F.lit("").alias("tipo_sangre"), F.col("blood_raw").alias("rh"), F.when(F.col("doc_id") % 2 == 0, F.col("text_raw")).alias("nombre_completo"), F.col("text_raw").alias("apellidos"), F.col("number_raw").alias("nombres"))
    return records.defaults(x).select("doc_id", "tipo_sangre", "nombre_completo")


@query
def x01_lines(spark, sf_dir):
    return lines.explode_lines(X.card_text(spark, sf_dir))


@query
def x01_document_lines(spark, sf_dir):
    return lines.explode_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def x02_header_trim(spark, sf_dir):
    return lines.trim_headings(x01_lines(spark, sf_dir))


def _context(spark, sf_dir):
    return lines.with_context(x02_header_trim(spark, sf_dir))


def _writes(spark, sf_dir, **fields):
    x = _context(spark, sf_dir)
    w = lines.writes(x)
    return x.select("doc_id", "line_no", *(w[f].alias(n) for n, f in fields.items()))


@query
def x03_doc_state(spark, sf_dir):
    return _context(spark, sf_dir).select("doc_id", "line_no", "kind")


@query
def x04_lookahead(spark, sf_dir):
    return _writes(spark, sf_dir, number="numero_documento", birth="fecha_nacimiento", sex="sexo")


@query
def x05_lookbehind(spark, sf_dir):
    return _writes(spark, sf_dir, place="lugar_nacimiento", issued="fecha_expedicion", rh="rh")


@query
def x06_names(spark, sf_dir):
    return _writes(spark, sf_dir, name="nombre_completo")


@query
def x08_new_extras(spark, sf_dir):
    return _writes(spark, sf_dir, nationality="nacionalidad")


@query
def x09_last_write(spark, sf_dir):
    return lines.fold(_context(spark, sf_dir))


@query
def x10_number_fallback(spark, sf_dir):
    return X.card_text(spark, sf_dir).select("doc_id", lines.longest_number(F.col("text")).alias("number"))


@query
def x11_name_fallback(spark, sf_dir):
    return X.card_text(spark, sf_dir).select("doc_id", T.some(lines.capital_name(F.col("text"))).alias("name"))


@query
def x12_extract_by_lines(spark, sf_dir):
    return lines.extract_by_lines(X.card_text(spark, sf_dir), as_of())


@query
def x13_extract_regex(spark, sf_dir):
    return lines.extract_by_patterns(X.card_text(spark, sf_dir))


@query
def x14_extract_hybrid(spark, sf_dir):
    return lines.extract_hybrid(X.card_text(spark, sf_dir))


@query
def x15_wider_fallbacks(spark, sf_dir):
    return lines.extract_by_lines(X.card_text(spark, sf_dir), as_of(), wider=True)


def _words(spark, sf_dir):
    return layout.dedupe_words(layout.usable_words(X.words_raw(spark, sf_dir)))


def _lines(spark, sf_dir):
    return layout.assemble_lines(layout.cluster_lines(_words(spark, sf_dir)))


@query
def l01_word_dedupe(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "page_no", "config_ord", "word_ord", "text", "norm", "x", "y", "w", "h", "cx", "cy", "conf")


@query
def l02_line_clustering(spark, sf_dir):
    return layout.cluster_lines(_words(spark, sf_dir)).select("doc_id", "page_no", "config_ord", "word_ord", "line_id")


@query
def l03_line_assembly(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "page_no", "line_no", "text", "norm", "x1", "y1", "x2", "y2", "cx", "cy")


@query
def l04_find_labels(spark, sf_dir):
    return layout.find_labels(_lines(spark, sf_dir)).select("doc_id", "page_no", "field", "line_no", "label", "score")


@query
def l05_neighbours(spark, sf_dir):
    return layout.neighbours(_lines(spark, sf_dir)).select("doc_id", "page_no", "line_no", F.array_join("above", "|").alias("above"), F.array_join("below", "|").alias("below"))


@query
def l06_extract_by_labels(spark, sf_dir):
    return layout.extract_by_labels(_lines(spark, sf_dir))


@query
def l07_resembles_label(spark, sf_dir):
    return layout.resembles_label(_lines(spark, sf_dir)).select("doc_id", "page_no", "line_no", "is_label")


@query
def l08_detect_side(spark, sf_dir):
    return layout.detect_side(_lines(spark, sf_dir))


@query
def l09_by_labels(spark, sf_dir):
    return layout.by_labels(_lines(spark, sf_dir))


def _page_sizes(spark, sf_dir):
    k = F.col("o_orderkey")
    return X.orders(spark, sf_dir).select(k.alias("doc_id"), (F.pmod(k, F.lit(2)) + 1).cast("int").alias("page_no"), F.when(k % 3 == 0, "digital").otherwise("hologramas").alias("modelo"), (k % 2000 + 1).cast("int").alias("width"), (k % 1300 + 1).cast("int").alias("height"))


@query
def l10_zone_boxes(spark, sf_dir):
    return layout.zone_boxes(_page_sizes(spark, sf_dir))


@query
def l13_zone_values(spark, sf_dir):
    """Two readings of every zone that isn't empty; some have none."""
    k = F.col("doc_id")
    which = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(T.FIELDS) for x in (f, i))), F.col("field"))
    reading = lambda n: F.when((k + which) % n > 0, F.when(which == 0, X.pick(X.NUMBERS, k + n, k)).when(which == 4, X.pick(X.DATES, k + n, k)).when(which == 5, X.pick(X.SEXES, k + n, k)).when(which == 8, X.pick(X.BLOODS, k + n, k)).otherwise(X.pick(X.TEXTS, k + n, k)))
    readings = layout.zone_boxes(_page_sizes(spark, sf_dir)).select("doc_id", "page_no", "template", "field", F.array(reading(3), reading(4)).alias("readings"))
    return layout.zone_values(readings)


@query
def l11_template(spark, sf_dir):
    return _page_sizes(spark, sf_dir).select("doc_id", "page_no", layout.template(F.col("modelo"), F.col("page_no")).alias("template"))


@query
def l12_line_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "page_no", "line_no", layout.line_text(F.col("items")).alias("text"))


def _quads(spark, sf_dir):
    k = F.col("o_orderkey")
    p = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    w, h = F.lit(300) + k % 90, F.lit(200) + k % 40
    return X.orders(spark, sf_dir).select(k.alias("doc_id"), F.array(p(w, h + k % 7), p(F.lit(10) + k % 5, F.lit(12)), p(w + k % 11, F.lit(15) + k % 3), p(F.lit(8) + k % 4, h)).alias("points"))


@query
def v01_order_corners(spark, sf_dir):
    x = _quads(spark, sf_dir).select("doc_id", layout.order_corners(F.col("points")).alias("c"))
    at = lambda i, j: F.element_at(F.element_at("c", i), j)
    return x.select("doc_id", *(at(i, j).alias(f"{n}_{'xy'[j - 1]}") for i, n in enumerate(("tl", "tr", "br", "bl"), 1) for j in (1, 2)))


@query
def v02_card_score(spark, sf_dir):
    x = _quads(spark, sf_dir).select("doc_id", layout.order_corners(F.col("points")).alias("c"))
    area = (F.lit(290.0) + F.col("doc_id") % 90) * (F.lit(180.0) + F.col("doc_id") % 40)
    return x.select("doc_id", F.round(layout.score_card(area, F.col("c"), F.lit(900.0), F.lit(700.0)), 9).alias("score"))


def _rasters(spark, sf_dir):
    """The bytes of each whole document as a raster 24 pixels wide, the last row filled up with black."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("image_id"), content.alias("b")).repartition(spark.sparkContext.defaultParallelism)
    rows = rows.withColumns({"width": F.lit(24), "height": F.greatest(F.lit(1), F.ceil(F.length("b") / 24)).cast("int")})
    return rows.select("image_id", "width", "height", F.expr("rpad(b, width * height, X'00')").alias("pixels"))


def _shown(rasters):
    return rasters.select("image_id", "width", "height", F.sha2("pixels", 256).alias("sha256"), "error")


@query
def v03_rectified(spark, sf_dir):
    """A tilted quadrilateral of each raster as an upright one of 48 by 30."""
    x, h = F.pmod(F.col("image_id"), F.lit(5)).cast("double"), F.col("height").cast("double")
    p = lambda a, b: F.array(a, b)
    corners = layout.order_corners(F.array(p(F.lit(20.0) - x / 2, h - 1), p(x, F.lit(0.0)), p(F.lit(23.0) - x, h / 9), p(x / 3, h * 0.9)))
    return _shown(raster.rectified(_rasters(spark, sf_dir).withColumn("corners", corners), size=(48, 30)))


@query
def v04_outlines(spark, sf_dir):
    """The parts of the bright pixels of each raster, with their outlines."""
    masks = raster.binarised(_rasters(spark, sf_dir), "text").withColumnRenamed("image_id", "doc_id")
    return outlines.outlines(masks).withColumns({"points": F.to_json("points"), "area": F.round("area", 6)})


@query
def v05_field_threshold(spark, sf_dir):
    return _shown(raster.binarised(_rasters(spark, sf_dir), "field"))


@query
def v06_page_threshold(spark, sf_dir):
    return _shown(raster.binarised(_rasters(spark, sf_dir), "page"))


@query
def v07_text_threshold(spark, sf_dir):
    return _shown(raster.binarised(_rasters(spark, sf_dir), "text"))


@query
def v04_choose_card(spark, sf_dir):
    """Two quadrilaterals an image, of which some aren't convex, and two regions; some images lack one or both."""
    k = F.col("doc_id")
    images = X.orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.lit(900).alias("width"), F.lit(700).alias("height"))
    each = images.withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    o = F.col("ord")
    w, h = (F.lit(180) + k % 97 * 3 + o * 40).cast("double"), (F.lit(150) + k % 83 * 2 + o * 10).cast("double")
    p = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    a, b, c, d = p(F.lit(5) + k % 3, F.lit(7)), p(w, F.lit(4) + k % 6), p(w + k % 5, h), p(F.lit(2), h + k % 4)
    quads = each.filter(k % 4 > 0).select("doc_id", "ord", (w * h * 0.93).alias("area"), F.when((k + o) % 5 == 0, F.array(a, c, b, d)).otherwise(F.array(a, b, c, d)).alias("points"))
    regions = each.filter(k % 3 > 0).select("doc_id", "ord", (w * h * 0.8).alias("area"), (k % 50).cast("int").alias("x"), (k % 30 * 20).cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    out = layout.choose_card(images, quads, regions)
    return out.select("doc_id", "detected", "method", "score", "aspect", F.element_at(F.element_at("corners", 1), 1).alias("tl_x"), F.element_at(F.element_at("corners", 3), 2).alias("br_y"), *(F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


def _source(spark, sf_dir, name):
    return X.candidates(spark, sf_dir).filter(F.col("source") == name)


def _latest(spark, sf_dir, name):
    """Of each field the value of the latest page that has it, valid or not."""
    return _source(spark, sf_dir, name).groupBy("doc_id", "field").agg(F.max_by("value", "page_no").alias("value"))


@query
def r01_text_merge(spark, sf_dir):
    return reconcile.merge_text(_source(spark, sf_dir, "text"))


@query
def r02_general_accumulate(spark, sf_dir):
    return reconcile.accumulate_general(_source(spark, sf_dir, "general"))


@query
def r03_crop_accumulate(spark, sf_dir):
    return reconcile.accumulate_crop(_source(spark, sf_dir, "crop"))


@query
def r04_compare(spark, sf_dir):
    return reconcile.compare(_latest(spark, sf_dir, "general"), _latest(spark, sf_dir, "crop"))


@query
def r05_field_union(spark, sf_dir):
    pages = lambda n: _source(spark, sf_dir, n).select("doc_id", "field", "value").dropDuplicates(["doc_id", "field"])
    return reconcile.compare(pages("general"), pages("crop")).select("doc_id", "field")


@query
def r06_precedence(spark, sf_dir):
    return reconcile.precedence(X.candidates(spark, sf_dir))


@query
def r07_full_name(spark, sf_dir):
    crop = r03_crop_accumulate(spark, sf_dir).withColumn("field", F.when(F.col("field") == "lugar_nacimiento", "apellidos").otherwise(F.col("field")))
    return reconcile.rebuild_name(crop, crop)


@query
def r08_combine(spark, sf_dir):
    return reconcile.combine(_latest(spark, sf_dir, "crop"), _latest(spark, sf_dir, "general"))


def _envelope(spark, sf_dir):
    text = lines.extract_by_lines(X.card_text(spark, sf_dir), as_of())
    return reconcile.envelope(text, reconcile.wide_precedence(X.candidates(spark, sf_dir)))


@query
def r09_values(spark, sf_dir):
    """Every value of every document's envelope, from the path that was taken."""
    return _envelope(spark, sf_dir).select("doc_id", "metodo", F.explode("resultado").alias("field", "value"))


@query
def r09_envelope(spark, sf_dir):
    return _envelope(spark, sf_dir).select("doc_id", "metodo", "error", F.size(F.coalesce("resultado", F.create_map().cast("map<string,string>"))).alias("n_fields"))


def _tables(spark, sf_dir):
    x = records.accepted(records.defaults(X.extractions(spark, sf_dir)), X.users(spark, sf_dir))
    return x, X.students(spark, sf_dir), X.programs(spark, sf_dir)


@query
def m01_student_upsert(spark, sf_dir):
    x, s, _ = _tables(spark, sf_dir)
    return records.upsert_students(x, s)


@query
def m02_program_get_or_create(spark, sf_dir):
    x, _, p = _tables(spark, sf_dir)
    return records.ensure_programs(x, p)


@query
def m03_document_append(spark, sf_dir):
    none = spark.createDataFrame([], "Id int")
    done = records.consolidate(X.extractions(spark, sf_dir), X.users(spark, sf_dir), X.students(spark, sf_dir), X.programs(spark, sf_dir), none, arrived())
    return done.documents.drop("FechaSubida")


@query
def m04_user_gate(spark, sf_dir):
    x, u = X.extractions(spark, sf_dir).select("arrival_seq", "usuario_id"), X.users(spark, sf_dir)
    return records.known_users(x, u).select("arrival_seq", "usuario_id", F.lit(True).alias("known")).union(records.unknown_users(x, u).select("arrival_seq", "usuario_id", F.lit(False)))


def _requests(spark, sf_dir):
    k = F.col("o_orderkey")
    return X.orders(spark, sf_dir).select(k.alias("seq"), F.concat(F.lit("user"), F.floor(k / 2).cast("string"), F.lit("@example.org")).alias("email"), F.concat(F.lit("N"), k.cast("string")).alias("name"), F.lit(None).cast("string").alias("last_name"), F.lit("x").alias("password_hash"))


@query
def m05_register_unique(spark, sf_dir):
    return records.register(_requests(spark, sf_dir), X.users(spark, sf_dir)).select("Id", "Email", "Nombre", "ConteoIngresos")


def _logins(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"), (F.col("event_id") % 5 > 0).alias("verified"))


def _streamed(spark, rows, order, start, batches=3):
    """Writes rows to a folder part by part, cut by an order; `start(stream, folder)` starts the stream anew over each part and the ones before."""
    root = shared_folder(spark)
    cuts = records.bounds_of(rows, order)
    picked = sorted({cuts[len(cuts) * i // batches] for i in range(1, batches)}) if cuts else []
    for low, high in zip([None, *picked], [*picked, None], strict=True):
        part = rows if low is None else rows.filter(F.col(order) > low)
        (part if high is None else part.filter(F.col(order) <= high)).write.mode("append").parquet(f"{root}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), root).awaitTermination()


@query
def m05_register_stream(spark, sf_dir):
    """The new users of a stream of all requests, restarted twice."""
    store, users = Store(spark, shared_folder(spark), accounts.USERS), X.users(spark, sf_dir)
    _streamed(spark, _requests(spark, sf_dir), "seq", lambda stream, at: accounts.register_stream(stream, store, users, f"{at}/checkpoint", once=True))
    return store.read("users").select("Id", "Email", "Nombre", "ConteoIngresos")


@query
def m06_login_stream(spark, sf_dir):
    """The users after a stream of all logins, restarted twice."""
    store = Store(spark, shared_folder(spark), accounts.COUNTS)
    _streamed(spark, _logins(spark, sf_dir), "event_id", lambda stream, at: accounts.count_stream(stream, store, f"{at}/checkpoint", once=True))
    return accounts.counted(X.users(spark, sf_dir), store.read("logins"))


@query
def m06_login_counter(spark, sf_dir):
    return records.count_logins(X.users(spark, sf_dir), _logins(spark, sf_dir).drop("event_id"))


@query
def snk2_verify_append(spark, sf_dir):
    """The batch's documents against the tables after it; the stored ones lack every 100th row."""
    none = spark.createDataFrame([], "Id int")
    users = X.users(spark, sf_dir)
    done = records.consolidate(X.extractions(spark, sf_dir), users, X.students(spark, sf_dir), X.programs(spark, sf_dir), none, arrived())
    stored = done.documents.withColumn("Id", F.when(F.col("Id") % 100 > 0, F.col("Id")))
    return records.verified(done.documents, done.students, done.programs, users, stored)


def _stored(spark, sf_dir):
    store = ingest.open_store(spark, shared_folder(spark), X.students(spark, sf_dir), X.programs(spark, sf_dir), fan=3)
    return ingest.consolidate_in_batches(X.extractions(spark, sf_dir), X.users(spark, sf_dir), store, batches=4, uploaded=arrived())


@query
def m07_store_students(spark, sf_dir):
    """The students of a store after four batches of all arrivals, merged on read."""
    return _stored(spark, sf_dir).read("students")


@query
def m07_store_documents(spark, sf_dir):
    """Each document that the batches published, with the number and the programme that its keys lead to in the store."""
    store = _stored(spark, sf_dir)
    base = store.manifest()
    s, p = (store.read(n, base) for n in ("students", "programs"))
    named = store.read("documents", base).join(s.select(F.col("Id").alias("EstudianteId"), "NumeroDocumento"), "EstudianteId").join(p.select(F.col("id").alias("ProgramaId"), "nombre"), "ProgramaId")
    return named.select("Id", "EstudianteId", "ProgramaId", "UsuarioId", "TipoDocumento", "Archivo", "NumeroDocumento", F.col("nombre").alias("Programa"))


@query
def m07_store_rejected(spark, sf_dir):
    """The arrivals that the batches refused, and why."""
    return _stored(spark, sf_dir).read("rejected").select("arrival_seq", "usuario_id", "programa", "reason")


@query
def src01_joined_text(spark, sf_dir):
    one = X.card_text(spark, sf_dir)
    two = one.select("doc_id", F.lit(2).alias("page_no"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("page two "), F.col("doc_id").cast("string"))).otherwise("  ").alias("text"))
    return recognise.joined_text(one.union(two))


@query
def src02_first_pages(spark, sf_dir):
    return recognise.first_pages(X.candidates(spark, sf_dir)).select("doc_id", "page_no").distinct()


@query
def src03_usable_words(spark, sf_dir):
    return layout.usable_words(X.words_raw(spark, sf_dir)).select("doc_id", "page_no", "config_ord", "word_ord", "text", "norm", "cx", "cy")


@query
def src05_first_student(spark, sf_dir):
    return records.first_by(X.students(spark, sf_dir), "NumeroDocumento", "Id").select("Id", "NumeroDocumento")


@query
def src06_literal_sql(spark, sf_dir):
    return database.query(spark, "SELECT Id, Email, ConteoIngresos FROM {usuarios} ORDER BY Id LIMIT 1", usuarios=X.users(spark, sf_dir))


@query
def src05_lookup(spark, sf_dir):
    return records.lookup(X.students(spark, sf_dir), "NumeroDocumento", "20000013", "Id").select("Id", "NumeroDocumento")


@query
def src05_store_lookup(spark, sf_dir):
    """The same student from a store, of which one bucket is read."""
    store = ingest.open_store(spark, shared_folder(spark), X.students(spark, sf_dir), X.programs(spark, sf_dir))
    return store.lookup("students", "20000013", "Id").select("Id", "NumeroDocumento")


@query
def snk1_landing_path(spark, sf_dir):
    return X.extractions(spark, sf_dir).select("arrival_seq", files.landing_path("documentos", F.col("programa"), F.col("usuario_id"), arrived(), F.col("archivo")).alias("path"))


def _landed(spark, sf_dir):
    """Each web page as a file whose lines are pages, landed under its programme's folder."""
    k, program = F.col("page_id"), F.element_at(F.array(*map(F.lit, ("Sistemas", "Cocina fria", "Redes"))), (F.col("page_id") % 3 + 1).cast("int"))
    path = F.substring(files.landing_path("", program, k, arrived(), F.concat(F.lit("page "), k.cast("string"))), 2, 1_000)
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(path.alias("path"), F.replace(F.coalesce("html", F.lit("")), F.lit("\n"), F.lit("\f")).cast("binary").alias("content"))
    root = shared_folder(spark)
    landing.land(rows.repartition(spark.sparkContext.defaultParallelism), root)
    return root


@query
def snk1_landed_files(spark, sf_dir):
    """What has landed, read again as binary files."""
    root = _landed(spark, sf_dir)
    found = recognise.files(spark, root)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


@query
def src02_page_source(spark, sf_dir):
    """The first two pages of all landed files; the source is told and reads no third one."""
    return recognise.first_pages(landing.card_pages(spark, _landed(spark, sf_dir), recognise.PlainText(), partition_bytes=1 << 20))


@query
def snk3_crop_url(spark, sf_dir):
    path = F.concat(F.lit("/app/api/documentos/"), F.col("programa"), F.lit("/ocr_debug/"), files.crop_name(F.lit(1), F.lit("nombres")))
    return X.extractions(spark, sf_dir).select("arrival_seq", files.crop_url("https://example.org/", path).alias("url"))

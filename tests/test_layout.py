"""Layout operators against plain Python over random pages."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cardloom.operators import layout as L


def page(rng, doc):
    words = ["NUMERO", "12345678", "GOMEZ", "APELLIDOS", "ANA LUZ", "NOMBRES", "SEXO", "M", "FECHA DE NACIMIENTO", "17-AGO-1990", "CALI", "LUGAR DE NACIMIENTO", "APELL1DOS", "O+", "RH", "NACIONALIDAD", "COLOMBIANA"]
    return [(doc, 1, 0, i, rng.choice(words), 90.0, rng.randrange(0, 600, 7), rng.randrange(0, 200), 40, rng.choice((10, 20, 30))) for i in range(rng.randrange(1, 14))]


def words(spark, seed=0, docs=40):
    rng = random.Random(seed)
    raw = [w for d in range(docs) for w in page(rng, d)]
    return L.usable_words(spark.createDataFrame(raw, "doc_id long, page_no int, config_ord int, word_ord int, text string, conf double, x int, y int, w int, h int"))


def test_line_clustering(spark):
    w = words(spark)
    got = {(r.doc_id, r.word_ord): r.line_id for r in L.cluster_lines(w).collect()}
    pages = {}
    for r in w.collect():
        pages.setdefault(r.doc_id, []).append(r)
    for doc, rows in pages.items():
        lines = []
        for r in sorted(rows, key=lambda r: (r.cy, r.x, r.config_ord, r.word_ord)):
            fits = [i for i, line in enumerate(lines) if abs(r.cy - sum(x.cy for x in line) / len(line)) <= max(12, 0.6 * max(r.h, *(x.h for x in line)))]
            if fits:
                lines[fits[0]].append(r)
            else:
                fits = [len(lines)]
                lines.append([r])
            assert got[doc, r.word_ord] == fits[0]


def similar(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.95 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


def norm(x):
    return {"NÚMERO": "NUMERO", "IDENTIFICACIÓN": "IDENTIFICACION", "FECHA DE NACIMIENTO:": "FECHA DE NACIMIENTO", "FECHA Y LUGAR DE EXPEDICIÓN": "FECHA Y LUGAR DE EXPEDICION", "FECHA EXPEDICIÓN": "FECHA EXPEDICION"}.get(x, x)


def test_labels_found(spark):
    lines = L.assemble_lines(L.cluster_lines(words(spark, 1))).cache()
    got = {(r.doc_id, r.field): (r.line_no, r.label, r.score) for r in L.find_labels(lines).collect()}
    pages = {}
    for r in lines.orderBy("doc_id", "line_no").collect():
        pages.setdefault(r.doc_id, []).append(r)
    expected = {}
    for doc, ls in pages.items():
        for field, labels in L.LABELS.items():
            best = None
            for line in ls:
                for label in labels:
                    s = similar(line.norm, norm(label))
                    if norm(label) in line.norm:
                        s = max(s, 0.96)
                    s = max([s, *(similar(w, norm(label)) for w in line.norm.split() if len(w) >= 3)])
                    if s >= 0.62 and (best is None or s > best[2]):
                        best = (line.line_no, label, s)
            if best:
                expected[doc, field] = best
    assert got == expected and got


def test_values_beside_labels(spark):
    texts = ["GOMEZ PEREZ", "APELLIDOS", "ANA LUZ", "NOMBRES", "NUMERO", "1.234", "12345678", "SEXO M F", "RH", "O+", "FECHA DE NACIMIENTO 17-AGO-1990", "CALI", "VALLE", "LUGAR DE NACIMIENTO", "NACIONALIDAD COLOMBIANA"]
    rows = [(1, 1, 0, 100 * i + j, w, 90.0, 50 * j, 100 * i, 40, 20) for i, t in enumerate(texts) for j, w in enumerate(t.split())]
    w = L.usable_words(spark.createDataFrame(rows, "doc_id long, page_no int, config_ord int, word_ord int, text string, conf double, x int, y int, w int, h int"))
    lines = L.assemble_lines(L.cluster_lines(w))
    got = {r.field: r.value for r in L.extract_by_labels(lines).collect()}
    assert got["apellidos"] == "Gomez Perez" and got["nombres"] == "Ana Luz" and got["numero_documento"] == "12345678"
    assert got["sexo"] == "Femenino" and got["tipo_sangre"] == "O+" and got["fecha_nacimiento"] == "1990-08-17"
    assert got["lugar_nacimiento"] == "Cali Valle" and got["nacionalidad"] == "Colombiana"
    side = L.detect_side(lines).first()
    assert side.lado == "reverso"
    by = {r.field: r.value for r in L.by_labels(lines).collect()}
    assert set(by) == set(L.SIDE_FIELDS["reverso"]) and by["sexo"] == "Femenino" and by["fecha_nacimiento"] is None


def test_zones_and_corners(spark):
    pages = spark.createDataFrame([(1, 1, "digital", 1000, 500), (2, 2, "hologramas", 1, 1)], "doc_id long, page_no int, modelo string, width int, height int")
    boxes = {(r.doc_id, r.field): (r.left, r.top, r.right, r.bottom) for r in L.zone_boxes(pages).collect()}
    assert boxes[1, "sexo"] == (450, 175, 550, 200) and not any(d == 2 for d, _ in boxes)
    quad = spark.range(1).select(L.order_corners(F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((300, 200), (0, 0), (300, 0), (0, 200))))).alias("c"))
    assert quad.first().c == [[0, 0], [300, 0], [300, 200], [0, 200]]
    score = quad.select(L.score_card(F.lit(60000.0), F.col("c"), F.lit(400.0), F.lit(300.0)).alias("s")).first().s
    assert abs(score - (0.35 + 0.40 * (1 - abs(1.5 - L.CARD_ASPECT) / L.CARD_ASPECT / 0.35) + 0.25)) < 1e-9


def test_sides_and_likeness(spark):
    lines = L.assemble_lines(L.cluster_lines(words(spark, 2))).cache()
    pages = {}
    for r in lines.orderBy("doc_id", "line_no").collect():
        pages.setdefault(r.doc_id, []).append(r.norm)
    variants = [norm(x) for xs in L.LABELS.values() for x in xs]
    marked = {(r.doc_id, r.line_no): r.is_label for r in L.resembles_label(lines).collect()}
    sides = {r.doc_id: (r.front, r.back) for r in L.detect_side(lines).collect()}
    for doc, norms in pages.items():
        for i, n in enumerate(norms):
            assert marked[doc, i] == (n != "" and any(v in n or similar(n, v) >= 0.75 for v in variants))
        whole = " ".join(" ".join(norms).split())
        points = lambda labels: sum(2 if x in whole else int(any(similar(w, x) >= 0.7 for w in whole.split())) for x in map(norm, labels))  # noqa: B023, E731
        assert sides[doc] == (points(L.FRONT_LABELS), points(L.BACK_LABELS))
    assert L.resembles_label(lines).columns == [*lines.columns, "is_label"]


def test_convex(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]]
    cases = [(square, True), (square[::-1], True), ([square[0], square[2], square[1], square[3]], False), ([*square[:3], [3.0, 1.0]], False), (square[:3], False), ([*square, [1.0, 1.0]], False)]
    df = spark.createDataFrame(cases, "p array<array<double>>, ok boolean")
    assert df.filter(L.convex(F.col("p")) != F.col("ok")).count() == 0


def test_empty_pages(spark):
    none = words(spark).limit(0)
    lines = L.assemble_lines(L.cluster_lines(none))
    assert lines.count() == L.find_labels(lines).count() == L.by_labels(lines).count() == 0

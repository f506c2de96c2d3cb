"""Scalar functions against values worked out by hand, and their properties."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.functions import similar
from cardloom.functions import text as T
from cardloom.functions.similar import similarity
from cardloom.operators import layout


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.normalize, {"NACIMIÉNTO": "NACIMIENTO", " número: ": "NUMERO", "g.s. rh+": "G.S. RH+", "a\u0301b": "AB", "": "", None: "", "—": ""}),
        (T.upper_plain, {"República": "REPÚBLICA", "REPÚBLICA": "REPUBLICA", None: None}),
        (T.digits, {"1.234-5": "12345", "abc": None, "": None, None: None}),
        (T.clean_text, {"  ana   maría3 ": "Ana María", "123": None, "O'NEIL": "Oneil", None: None}),
        (T.parse_date, {"17-AGO-1990": "1990-08-17", "x 7/8/1990": "1990-08-07", "30-FEB-2000": None, "5-XYZ-1990": None, "5-XYZ-1990 1/2/2003": "2003-02-01", "1990-08-17": None, None: None}),
        (T.parse_date_lenient, {"30-FEB-2000": "2000-02-30", "5-XYZ-1990": "1990-01-05", " 17/08/1990 ": "17/08/1990", None: ""}),
        (T.find_date, {"el 17-ago-1990 x": "17-ago-1990", "7/8/1990": None}),
        (T.sex, {" masc": "Masculino", "F": "Femenino", "x": None, "": None}),
        (T.blood, {"0 +": "O+", "CEDULA-123": "A-", "ab-": "AB-", "B": None}),
        (T.blood_prefix, {"oo+x": "OO+", "x O+": "", None: ""}),
        (T.document_type, {"12345678": "colombia_cedula", "123456": "colombia_tarjeta", "1": "extranjero", None: "extranjero"}),
    ],
)
def test_values(spark, f, cases):
    assert run(spark, f, list(cases)) == list(cases.values())


def test_age(spark):
    day = F.lit(dt.date(2023, 2, 28))
    cases = {"29-FEB-1992": 30, "28 FEB 1992": 31, "1-ENE-2001": 22, "2-AUG-1988": 34, "17/08/1990": None, "": None, None: None, "30-FEB-1990": None}
    assert run(spark, lambda c: T.age(c, day), list(cases)) == list(cases.values())


def test_valid(spark):
    cases = [("numero_documento", "123456", True), ("numero_documento", "1234567890123", False), ("fecha_nacimiento", "2001-02-29", False), ("fecha_nacimiento", "2000-02-29", True), ("sexo", "M", False), ("tipo_sangre", "AB+", True), ("nombres", "a b", False), ("nombres", "Ana", True), ("otro", "x", True), ("otro", " ", False), ("sexo", None, False)]
    df = spark.createDataFrame(cases, "f string, v string, ok boolean")
    assert df.filter(~T.valid(F.col("f"), F.col("v")).eqNullSafe(F.col("ok"))).count() == 0


def test_similarity(spark):
    from difflib import SequenceMatcher

    pairs = [("tide", "diet"), ("diet", "tide"), ("APELLIDO", "APELLIDOS"), ("NOMBR3S", "NOMBRES"), ("", "X"), ("á", "A"), (None, "A")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [SequenceMatcher(None, "TIDE", "DIET").ratio(), SequenceMatcher(None, "DIET", "TIDE").ratio()] != [0, 0]
    assert got[2:] == [0.95, SequenceMatcher(None, "NOMBR3S", "NOMBRES").ratio(), 0.0, 1.0, 0.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aáÑO0+-AB 19/\t.x", max_size=12), min_size=1, max_size=40))
def test_cleaners_are_idempotent(spark, values):
    for f in (T.digits, T.clean_text, T.sex, T.blood):
        once = run(spark, f, values)
        assert run(spark, f, once) == once
    for v in run(spark, T.parse_date, values):
        assert v is None or dt.date.fromisoformat(v)


def test_texts_apart_by_numbers_are_compared_once(spark):
    rng = random.Random(9)
    labels = ["NÚMERO", "NUM.", "G. S. RH", "", "SEXO", "SEXO", "LUGAR DE NACIMIENTO"]
    texts = [None, "", " ", "sexo", "núm", "NUMERO 12", "x#7 rh+", *("".join(rng.choice("ACEGHIMNORSUX.+#07 ñ") for _ in range(rng.randrange(1, 24))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((r.i, r.label, r.similarity) for r in similar.compared_with(df, "t", labels).collect())
    norms = dict(df.select("i", T.normalize(F.col("t"))).collect())
    assert got == sorted((i, x, similar.likeness(norms[i], similar.plain(x))) for i in norms for x in labels)
    assert got == sorted(map(tuple, df.crossJoin(spark.createDataFrame([(x,) for x in labels], "label string")).select("i", "label", similarity(F.col("t"), F.col("label"))).collect()))
    cards = spark.range(3000).select(F.concat(F.lit("José Núñez "), F.col("id") + 10_000_000).alias("t"))
    assert cards.select(similar.form(F.col("t"), tuple(map(similar.plain, labels)))).distinct().count() == 1


def test_similar_pairs_lose_nothing_to_their_bounds(spark):
    rng = random.Random(8)
    labels = [similar.plain(x) for xs in layout.LABELS.values() for x in xs]
    texts = [None, "", "A", "NUMERO", "NOMBRE S", "SEX0", *("".join(rng.choice("ABCEMNORSU ") for _ in range(rng.randrange(1, 14))).strip() for _ in range(200))]
    texts += ["".join(c if rng.random() > 0.2 else rng.choice("AEIOX") for c in x) for x in labels for _ in range(3)]
    df = spark.createDataFrame([(t,) for t in texts * 2], "t string")
    got = {(r.text, r.label): r.similarity for r in similar.similar_pairs(df, labels, 0.62).collect()}
    expected = {(t, x): s for t in set(filter(None, texts)) for x in set(labels) if (s := similar.likeness(t, x)) >= 0.62}
    assert got == pytest.approx(expected) and len(got) > 100
    assert similar.open_pairs(df, labels, 0.62).count() < 0.2 * len(set(filter(None, texts))) * len(set(labels))

"""Lines, reconciliation, consolidation, sources and the stream on small inputs."""

import datetime as dt
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cardloom.operators import layout, lines, reconcile, records
from cardloom.plans import fixtures as X
from cardloom.sources import database, files, recognise

SF = "/root/testdata/sf0.001"


def test_line_ends_and_gaps(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, None), (4, "\n"), (5, "x\u2028y")], "doc_id long, text string")
    got = {}
    for r in lines.explode_lines(df).collect():
        got.setdefault(r.doc_id, []).append(r.raw)
    assert got == {1: ["a", "b", "", "c"], 4: [""], 5: ["x", "y"]}
    out = {r.doc_id: r for r in lines.extract_by_lines(df, F.current_date()).collect()}
    assert set(out) == {1, 2, 3, 4, 5} and out[3].numero_documento is None


def test_last_write_wins(spark):
    text = "COLOMBIA\nNUIP 1\n55\nFECHA DE NACIMIENTO\n1-ENE-2001\nNACIONALIDAD\nCOL\nO+A\nAPELLIDOS\nGIL\nNOMBRES\nNUMERO\n77"
    r = lines.extract_by_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), F.lit(dt.date(2020, 6, 1))).first()
    assert (r.numero_documento, r.edad, r.nacionalidad, r.rh, r.nombre_completo) == ("77", 19, "COL", "O+A", "GIL")


def test_comparison_stays_with_its_inputs(spark):
    both = reconcile.compare(X.candidates(spark, SF).filter("source = 'general' AND page_no = 1"), X.candidates(spark, SF).filter("source = 'crop' AND page_no = 1"))
    assert both.filter("value IS NOT NULL AND NOT (value <=> general) AND NOT (value <=> crop)").count() == 0


def test_replay_is_idempotent(spark):
    x = X.extractions(spark, SF).filter("numero_documento <> ''")
    once = records.upsert_students(x, X.students(spark, SF))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(records.upsert_students(x, once)) == rows(once)


def test_documents_find_their_nameless_students_either_way(spark):
    x, s, p = records.known_users(X.extractions(spark, SF), X.users(spark, SF)), X.students(spark, SF).filter("NumeroDocumento IS NOT NULL"), X.programs(spark, SF)
    none, when = spark.createDataFrame([], "Id int"), F.to_timestamp(F.lit(X.ARRIVED))
    done = records.consolidate(x, X.users(spark, SF), s, p, none, when)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(records.append_documents(x, done.students, done.programs, none, when)) == rows(done.documents)


def test_empty_batches(spark):
    x, s, p = X.extractions(spark, SF).limit(0), X.students(spark, SF), X.programs(spark, SF)
    done = records.consolidate(x, X.users(spark, SF), s, p, spark.createDataFrame([], "Id int"), F.current_timestamp())
    assert done.students.count() == s.count() and done.programs.count() == 3 and done.documents.count() == 0


def test_numbering_has_no_gaps(spark):
    got = [r.k for r in records.numbered(spark.range(1000).withColumnRenamed("id", "s"), "s", spark.createDataFrame([(41,)], "k int"), "k").orderBy("s").collect()]
    assert got == list(range(42, 1042))


@pytest.mark.parametrize("parts", [1, 300, 5000])
def test_numbering_for_any_number_of_partitions(spark, parts):
    rows = spark.range(0, 6000, 1, 7).select((F.col("id") * 37 % 6007).alias("s"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = records.numbered(rows, "s", spark.createDataFrame([], "k long"), "k").select("s", "k").toPandas().sort_values("s")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["k"].tolist() == list(range(1, 6001))


def test_documents_are_the_first_query_of_a_session():
    run = """
from pyspark.sql import SparkSession
from cardloom.plans.queries import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
rows = QUERIES["m03_document_append"](spark, %r).select("Id").collect()
print(sorted(r.Id for r in rows) == list(range(1, len(rows) + 1)), len(rows) > 1000)
""" % SF
    done = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["True", "True"], done.stderr[-3000:]


def test_range_of_a_value(spark):
    bounds = [3, 5, 9, 9_000_000_000]
    values = [-1, 3, 4, 5, 6, 9, 10, 9_000_000_000, 9_000_000_001]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for n in range(len(bounds) + 1):
        assert [r[0] for r in df.select(records.range_of(F.col("v"), bounds[:n])).collect()] == [sum(b < v for b in bounds[:n]) for v in values]


def test_one_pass_merges_as_the_three(spark):
    c = X.candidates(spark, SF)
    by = {n: {(r.doc_id, r.field): r.value for r in f(c.filter(F.col("source") == n)).collect()} for n, f in (("text", reconcile.merge_text), ("general", reconcile.accumulate_general), ("crop", reconcile.accumulate_crop))}
    rows = reconcile.merged(c).collect()
    assert {n: {(r.doc_id, r.field): r[n] for r in rows if r[n] is not None} for n in by} == by


def test_a_document_s_candidates_meet_once(spark):
    other = spark.createDataFrame([(-1, 1, "otro", "text", "x"), (-2, 1, "sexo", "text", "x"), (-3, 1, "nombres", "elsewhere", "Ana"), (-4, 2, "nombres", "text", "Luz"), (-4, 1, "nombres", "text", "Ana"), (-4, None, "nombres", "crop", "Eva")], "doc_id long, page_no int, field string, source string, value string")
    c = X.candidates(spark, SF).unionByName(other)
    rows = lambda df: sorted(map(str, df.collect()))
    one = reconcile.wide_precedence(c)
    assert rows(one) == rows(reconcile.wide(reconcile.precedence(c))) and {r.doc_id: r.nombres for r in one.filter("doc_id < 0").collect()} == {-1: "", -3: "", -4: "Ana"}
    assert reconcile.wide_precedence(other)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1


def test_lines_of_a_text_stay_in_its_row(spark):
    rng = random.Random(4)
    pieces = ["COLOMBIA", "Republica", "cédula", "IDENTIFICACIÓN", "NUMERO", "NUMER0", "NUIP 7", "1.234", "APELLIDOS", "NOMBRES", " GIL ", "", "Ana\tLuz", "SEXO", "femenino", "M", "RH", "O+ A-", "NACIONALIDAD", "COL", "FECHA DE NACIMIENTO", "1-ENE-2001", "LUGAR DE NACIMIENTO", "CALI!", "EXPEDICION"]
    ends = ["\n", "\n", "\r\n", "\r", "\u2028"]
    df = spark.createDataFrame([(i, "".join(rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randrange(14))) + rng.choice(["", "RH"])) for i in range(600)], "doc_id long, text string")
    out = lines.extract_by_lines(df, F.current_date())
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    fields = [f for f in lines.TEXT_FIELDS if f not in ("numero_documento", "nombre_completo")]
    by_window = {r.doc_id: r for r in lines.fold(lines.with_context(lines.trim_headings(lines.explode_lines(df)))).collect()}
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(range(600)) and len(by_window) > 400
    assert all(tuple(by_window[i][f] if i in by_window else None for f in fields) == tuple(r[f] for f in fields) for i, r in got.items())
    assert all(by_window[i][f] in (None, "", r[f]) for i, r in got.items() if i in by_window for f in ("numero_documento", "nombre_completo"))


def test_verification_finds_what_is_missing(spark):
    docs = spark.createDataFrame([(1, 10, 20, 30), (2, 11, 21, 31)], "Id int, EstudianteId int, ProgramaId int, UsuarioId int")
    one = lambda name, *ids: spark.createDataFrame([(i,) for i in ids], f"{name} int")
    rows = records.verified(docs, one("Id", 10, 11), one("id", 20), one("Id", 30, 30, 31), docs.filter("Id = 1")).orderBy("Id").collect()
    assert [tuple(r) for r in rows] == [(1, True, True, True, True), (2, False, True, False, True)]
    assert [r.Id for r in database.missing(docs, docs.filter("Id = 1"), "Id").collect()] == [2]
    assert records.lookup(docs, "UsuarioId", 31, "Id").first().Id == 2 and records.lookup(docs, "UsuarioId", 9, "Id").count() == 0


class Fake:
    def page_texts(self, content):
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode().split("\f")

    def words(self, content, page):
        if content == b"bad":
            raise ValueError("unreadable")
        return [(0, 0, f"w{page}", 90.0, 1, 2, 3, 4)]

    def size(self, content, page):
        if content == b"bad":
            raise ValueError("unreadable")
        return (1000, 500) if page <= content.count(b"\f") + 1 else None

    def field(self, content, page, field, box):
        return [" ", f"{field} {box[0]}", "later"]


def test_recogniser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\f \ftwo")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    found = recognise.files(spark, str(tmp_path))
    pages = recognise.pages(found, Fake())
    assert pages.filter("error IS NOT NULL").count() == 1
    assert [r.text for r in recognise.joined_text(pages.filter("text IS NOT NULL")).collect()] == ["one\ntwo\n"]
    rows = recognise.words(found, Fake()).collect()
    assert sorted((r.text or "", r.error) for r in rows) == [("", "unreadable"), ("w1", None), ("w2", None)]
    assert layout.usable_words(recognise.words(found, Fake())).count() == 2
    zones = recognise.zones(found, Fake(), "hologramas")
    assert zones.filter("error IS NOT NULL").count() == 1
    sizes = zones.filter("error IS NULL").select("doc_id", "page_no", F.lit("hologramas").alias("modelo"), F.lit(1000).alias("width"), F.lit(500).alias("height")).distinct()
    box = ["doc_id", "page_no", "template", "field", "left", "top", "right", "bottom"]
    plain = lambda df: sorted(map(tuple, df.select(*box).collect()))
    assert plain(zones.filter("error IS NULL")) == plain(layout.zone_boxes(sizes)) and len(plain(layout.zone_boxes(sizes))) == 7
    values = {r.field: r.value for r in layout.zone_values(zones).collect()}
    assert len(values) == 7 and values["apellidos"] == "Apellidos" and values["sexo"] is None
    assert spark.range(1).select(recognise.first_reading(F.lit(" "), F.lit("x"))).first()[0] == "x"


def test_arrivals_without_a_programme_are_refused(spark):
    users, none = spark.createDataFrame([(1,)], "Id int"), spark.createDataFrame([], "Id int")
    row = lambda seq, user, number, program: (seq, user, program, f"{seq}.pdf", number, "Ana", None, None, None, None, None)
    x = spark.createDataFrame([row(1, 1, "7", "Redes"), row(2, 1, "8", None), row(3, 9, "9", None), row(4, 1, None, None), row(5, 1, "8", "Redes")], X.extractions(spark, SF).schema)
    done = records.consolidate(x, users, X.students(spark, SF).limit(0), X.programs(spark, SF), none, F.current_timestamp())
    assert [(r.Id, r.Archivo) for r in done.documents.orderBy("Id").collect()] == [(1, "1.pdf"), (2, "5.pdf")]
    assert [(r.Id, r.NumeroDocumento) for r in done.students.orderBy("Id").collect()] == [(1, "7"), (2, "8")]
    assert [(r.arrival_seq, r.reason) for r in done.rejected.orderBy("arrival_seq").collect()] == [(2, "programa"), (3, "usuario"), (4, "programa")]
    assert spark.range(1).select(files.landing_path("d", F.lit(None).cast("string"), F.lit(1), F.current_timestamp(), F.lit("x"))).first()[0] is None


def test_database_urls():
    assert database.database_url("postgres://u:p@localhost/d") == "postgresql://u:p@localhost/d?sslmode=disable"
    assert database.database_url("postgresql://u@db.example.org:5432/d?a=1") == "postgresql://u@db.example.org:5432/d?a=1&sslmode=require"
    assert database.database_url("postgresql://h/d?sslmode=prefer").endswith("sslmode=prefer")
    assert database.database_url("postgres://h/d?a=b%20c#f") == "postgresql://h/d?a=b%20c&sslmode=require#f"
    assert database.database_url("postgresql://[::1]:5432/d?") == "postgresql://[::1]:5432/d?sslmode=disable"
    assert database.database_url("sqlite:///:memory:") == "sqlite:///:memory:"
    assert database.jdbc_options("postgres://u:p@localhost/d", "usuarios") == {"url": "jdbc:postgresql://localhost/d?sslmode=disable", "dbtable": "usuarios", "user": "u", "password": "p"}
    assert database.jdbc_options("postgresql://[::1]:5432/d", "t")["url"] == "jdbc:postgresql://[::1]:5432/d?sslmode=disable"
    with pytest.raises(RuntimeError):
        database.database_url(None)


def test_paths(spark):
    one = spark.range(1)
    url = lambda p, base="https://x/": one.select(files.crop_url(base, F.lit(p))).first()[0]
    assert url("C:\\a\\documentos\\p\\documentos\\f.png") == "https://x/ocr/debug/p/documentos/f.png"
    assert url("/elsewhere/f.png") is None and url("/documentos/f", "") is None
    safe = lambda p: one.select(files.safe_path(F.lit(p))).first()[0]
    assert safe("ocr_debug\\a/b.png") == "a/b.png" and safe("../x") is None and safe("a/../../x") is None

"""Synthetic inputs derived from the driver's tables, in Spark and in DuckDB SQL by the same arithmetic.

Cases are lists of values; a row's key picks one, and `{k}` in it becomes a number from the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ["{k}", "1.0{k}", "CC {k} x", "", None, "   ", "abc", "12345", "123456", "123456789012", "1234567890123", "N{k}-7"]
TEXTS = ["ana  maría", "JOSÉ ñuñez {k}", "O'Brien 3", "  luz\tmarina ", "", None, "x", "ab c", "República de  Colombia", "NÚMERO: {k}", "çelik+#1.5", "Álvaro Íñigo", "a b"]
DATES = [
    "17-AGO-1990", "3/ENE/2001", "03 FEB 1999", "30-FEB-2000", "29-FEB-2000", "29-FEB-2001", "5-XYZ-1990", "17/08/1990", "7-8-1990",
    "31/04/1990", "x 12/12/2012 y", "12 / 12 / 2012", "1990-08-17", "", None, "17-AGO-90", "1-DIC-1985", "01 JUL 1970 02/03/1971",
    "10-XYZ-1990 11/12/1991", "2-AUG-1988", "28-feb-1996", "7 mar 2004", " 9-OCT-1977", "29 FEB 1992",
]
SEXES = ["M", "f", "Masculino", " femenino", "X", "", None, "m x"]
BLOODS = ["O+", "0+", "AB-", "O +", "A B -", "CEDULA-1", "B", "", None, "oo+", "ab+ x", "+A", "B-"]
#: The day that ages are counted to, and the time of arrival.
AS_OF, ARRIVED = "2024-02-29", "2024-03-01 10:11:12"

RAW = {"number": (NUMBERS, 1), "text": (TEXTS, 1), "date": (DATES, 1), "sex": (SEXES, 3), "blood": (BLOODS, 7)}


def pick(cases: list, key: Column, number: Column) -> Column:
    """The case that the key picks, with the number in its place."""
    at = F.pmod(key, F.lit(len(cases))).cast("int") + 1
    return F.replace(F.element_at(F.array(*(F.lit(c).cast("string") for c in cases)), at), F.lit("{k}"), number.cast("string"))


def sql_text(x: str | None) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if "\n" not in x and "\t" not in x else " || ".join(f"chr({ord(c)})" if c in "\n\t" else "'" + c.replace("'", "''") + "'" for c in x)


def sql_pick(cases: list, key: str, number: str) -> str:
    listed = ", ".join(f"({sql_text(c)})" for c in cases)
    return f"replace(([{listed}])[CAST(({key}) % {len(cases)} AS INTEGER) + 1], '{{k}}', CAST({number} AS VARCHAR))"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the orders, dealt out: each makes many rows here, and the file may be a single split."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism)


def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per order with a raw value of every kind."""
    key = F.col("o_orderkey")
    number = key + 10_000_000
    columns = [pick(cases, F.floor(key / step).cast("long"), number).alias(f"{name}_raw") for name, (cases, step) in RAW.items()]
    return orders(spark, sf_dir).select(key.alias("doc_id"), *columns)


RAW_SQL = "SELECT o_orderkey AS doc_id, " + ", ".join(f"{sql_pick(c, f'o_orderkey // {s}', 'o_orderkey + 10000000')} AS {n}_raw" for n, (c, s) in RAW.items()) + " FROM orders"

# lines of a card, each block a list of variants.
HEADS = [[], ["REPUBLICA DE COLOMBIA"], ["REPÚBLICA DE COLOMBIA", "IDENTIFICACIÓN PERSONAL"], ["Republica", "CEDULA DE CIUDADANÍA", "COLOMBIA"], ["COLOMBIA", "cedula", "IDENTIFICACION", "CEDULA"]]
NUMBER_BLOCKS = [["NUMERO", "{k}"], ["NUMER0", " 1.{k} "], ["NUIP {k}", "10{k}"], ["Numéro", ""], ["ref {k} y 12345678"], ["NUMERO"]]
NAME_BLOCKS = [["GOMEZ", "APELLIDOS", "ANA LUZ", "NOMBRES"], ["ANA", "NOMBRES", "GOMEZ", "APELLIDOS"], ["PEREZ LUIS", "APELLIDOS NOMBRES"], ["MARIA DEL MAR"], ["sin datos"], ["apellido", "ROJAS"], ["", "NOMBRE"]]
BIRTH_BLOCKS = [["FECHA DE NACIMIENTO", "17-AGO-1990"], ["FECHA DE NACIMIENTO", "29 FEB 1992"], ["FECHA DE NACIMIENTO", ""], ["FECHA DE NACIMIENTO", "30-FEB-1990"], ["17/08/1990"], ["FECHA DE NACIMIENTO", "1-ENE-2001", "FECHA DE NACIMIENTO", "2-ENE-2002"]]
PLACE_BLOCKS = [["BOGOTA D.C.", "CUNDINAMARCA!", "LUGAR DE NACIMIENTO"], ["LUGAR DE NACIMIENTO"], ["CALI (VALLE)"], ["Lugar de nacimiento"]]
SEX_BLOCKS = [["SEXO", "M"], ["SEXO", "femenino"], ["SEXO", "X"], ["sexo: F"], ["O+M", "G.S. RH"], ["A- x", "RH", "SEXO", "F"], ["NACIONALIDAD", "COL"], ["GENERO M"]]
END_BLOCKS = [["12-MAR-2010 CALI", "FECHA Y LUGAR DE EXPEDICION"], ["EXPEDICION"], ["TIPO DE SANGRE: O+"], ["RH AB-"], ["SEXO"], ["O+a"], []]
BLOCKS = ((HEADS, 1), (NUMBER_BLOCKS, 1), (NAME_BLOCKS, 1), (BIRTH_BLOCKS, 3), (PLACE_BLOCKS, 5), (SEX_BLOCKS, 2), (END_BLOCKS, 11))


def _texts(blocks: list[list[str]]) -> list[str]:
    return ["".join(line + "\n" for line in b) for b in blocks]


def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text), a card of lines for every order."""
    key = F.col("o_orderkey")
    parts = [pick(_texts(b), F.floor(key / step).cast("long"), key + 10_000_000) for b, step in BLOCKS]
    return orders(spark, sf_dir).select(key.alias("doc_id"), F.lit(1).alias("page_no"), F.concat(*parts).alias("text"))


CARD_SQL = "SELECT o_orderkey AS doc_id, 1 AS page_no, " + " || ".join(sql_pick(_texts(b), f"o_orderkey // {s}", "o_orderkey + 10000000") for b, s in BLOCKS) + " AS text FROM orders"

# words of a page, several to an order.
WORDS = ["NUMERO", "Número", "GOMEZ", "ANA", "APELLIDOS", "NOMBRE", "SEX0", "M", "FECHA", "NACIMIENTO", "RH", "O+", "", " ", "CALI", "12345678", "LUGAR"]


def words_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recognised words with boxes, before any is dropped; each line item gives a word from two recogniser modes."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").repartition(spark.sparkContext.defaultParallelism)
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    mixed = k * 7 + n * 13
    base = li.select(
        k.alias("doc_id"), F.when(n > 5, 2).otherwise(1).alias("page_no"), n.alias("n"), mixed.alias("m"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("config_ord"),
    )
    m, c = F.col("m"), F.col("config_ord")
    return base.select(
        "doc_id", "page_no", "config_ord", F.col("n").alias("word_ord"),
        pick(WORDS, m, F.col("doc_id")).alias("text"),
        F.element_at(F.array(*map(F.lit, (14.9, 15.0, 15.1, 60.0, 91.5, -1.0))), (F.pmod(m + c, F.lit(6)) + 1).cast("int")).alias("conf"),
        (F.pmod(m * 3, F.lit(9)) * 55 + F.pmod(m, F.lit(3)) * 5 + c * F.pmod(m, F.lit(2)) * 5).cast("int").alias("x"),
        (F.pmod(m, F.lit(5)) * 27 + F.pmod(m, F.lit(4)) * 4 + c * 2).cast("int").alias("y"),
        (F.lit(40) + F.pmod(m, F.lit(7)) * 3).cast("int").alias("w"), (F.lit(14) + F.pmod(m, F.lit(3)) * 6).cast("int").alias("h"),
    )


WORDS_SQL = f"""SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber > 5 THEN 2 ELSE 1 END AS page_no, config_ord, l_linenumber AS word_ord, {sql_pick(WORDS, 'm', 'l_orderkey')} AS text,
  CAST(([14.9, 15.0, 15.1, 60.0, 91.5, -1.0])[CAST((m + config_ord) % 6 AS INTEGER) + 1] AS DOUBLE) AS conf,
  CAST((m * 3 % 9) * 55 + m % 3 * 5 + config_ord * (m % 2) * 5 AS INTEGER) AS x,
  CAST(m % 5 * 27 + m % 4 * 4 + config_ord * 2 AS INTEGER) AS y,
  CAST(40 + m % 7 * 3 AS INTEGER) AS w, CAST(14 + m % 3 * 6 AS INTEGER) AS h
FROM (SELECT *, l_orderkey * 7 + l_linenumber * 13 AS m FROM lineitem), (VALUES (0), (1)) AS c(config_ord)"""

# candidate values of three sources; F5: extractions that arrive one after the other.
FIELD_CASES = {
    "numero_documento": NUMBERS, "nombres": TEXTS, "fecha_nacimiento": ["1990-08-17", "1990-02-30", "17-AGO-1990", "", None, "2000-02-29"],
    "sexo": ["Masculino", "Femenino", "M", "", None], "tipo_sangre": BLOODS, "lugar_nacimiento": TEXTS,
}
SOURCES = ("text", "general", "crop")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, field, source, value) on two pages, with gaps."""
    key = F.col("o_orderkey")
    rows = [F.struct(F.lit(page).alias("page_no"), F.lit(field).alias("field"), F.lit(source).alias("source"), F.lit(f).alias("f"), F.lit(s).alias("s")) for page in (1, 2) for f, field in enumerate(FIELD_CASES) for s, source in enumerate(SOURCES)]
    out = orders(spark, sf_dir).select(key.alias("doc_id"), F.explode(F.array(*rows)).alias("c")).select("doc_id", "c.*")
    k, page, f, s = (F.col(c) for c in ("doc_id", "page_no", "f", "s"))
    out = out.filter(F.pmod(k + page + s + f, F.lit(5)) != 0).withColumn("at", F.floor(k / (1 + s)).cast("long") + page * (s + 1) + f)
    value = F.coalesce(*(F.when(F.col("field") == field, pick(cases, F.col("at"), k + 10_000_000)) for field, cases in FIELD_CASES.items()))
    return out.select("doc_id", "page_no", "field", "source", value.alias("value"))


CANDIDATES_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, {page} AS page_no, '{field}' AS field, '{source}' AS source, {sql_pick(cases, f'o_orderkey // {1 + s} + {page * (s + 1) + f}', 'o_orderkey + 10000000')} AS value FROM orders WHERE (o_orderkey + {page + s + f}) % 5 <> 0"
    for page in (1, 2) for f, (field, cases) in enumerate(FIELD_CASES.items()) for s, source in enumerate(SOURCES)
)

PROGRAMS = ["Sistemas", "Cocina", "Nuevo {k}", "Redes", "Sistemas", "Cocina", None]
PEOPLE = {"numero_documento": ["{k}", "{k}", "{k}", None, ""], "nombre_completo": ["Ana Luz", "", None, "Luis Gil"], "fecha_nacimiento": ["1990-08-17", "", "17-AGO-1990"], "sexo": ["Masculino", None, "Femenino", ""], "lugar_nacimiento": ["Cali", "", "Bogota", None, "Pasto"], "nacionalidad": ["Col", ""], "tipo_sangre": ["O+", "", None, "AB-"]}


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival_seq, usuario_id, programa, archivo, the fields); several arrivals share a number, some users are unknown, some programmes missing."""
    key = F.col("o_orderkey")
    who = F.floor(key / 3).cast("long")
    columns = [pick(cases, key if name != "numero_documento" else who, who + 20_000_000).alias(name) for name, cases in PEOPLE.items()]
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("arrival_seq"), F.col("o_custkey").cast("int").alias("usuario_id"), pick(PROGRAMS, key, F.floor(who / 50).cast("long")).alias("programa"),
        F.concat(F.lit("card "), key.cast("string"), F.lit(".pdf")).alias("archivo"), *columns,
    )


EXTRACTIONS_SQL = f"SELECT o_orderkey AS arrival_seq, CAST(o_custkey AS INTEGER) AS usuario_id, {sql_pick(PROGRAMS, 'o_orderkey', 'o_orderkey // 3 // 50')} AS programa, 'card ' || o_orderkey || '.pdf' AS archivo, " + ", ".join(
    f"{sql_pick(cases, 'o_orderkey' if name != 'numero_documento' else 'o_orderkey // 3', 'o_orderkey // 3 + 20000000')} AS {name}" for name, cases in PEOPLE.items()
) + " FROM orders"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usuarios, one for every customer, with an e-mail address and a login counter; one id in nine is no user's."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    ident = k + F.floor(k / 8)
    return c.select(ident.cast("int").alias("Id"), F.concat(F.lit("user"), ident.cast("string"), F.lit("@example.org")).alias("Email"), F.when(k % 3 > 0, (k % 3).cast("int")).alias("ConteoIngresos"))


USERS_SQL = "SELECT CAST(c_custkey + c_custkey // 8 AS INTEGER) AS Id, 'user' || (c_custkey + c_custkey // 8) || '@example.org' AS Email, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 AS INTEGER) END AS ConteoIngresos FROM customer"


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """estudiante, one for every customer: some numbers are held twice, some by none, and some arrive only later."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    number = F.when(k % 11 > 0, (k - F.when(k % 7 == 0, 1).otherwise(0) + 20_000_000).cast("string"))
    return c.select(k.cast("int").alias("Id"), number.alias("NumeroDocumento"), F.lit("Viejo Nombre").alias("NombreCompleto"), F.lit(None).cast("string").alias("FechaNacimiento"), F.when(k % 2 == 0, "Femenino").alias("Sexo"), F.lit("Tunja").alias("LugarNacimiento"), F.lit("").alias("Nacionalidad"), F.lit("B+").alias("TipoSangre"), F.lit("Archivo").alias("Programa"), (k % 30).cast("int").alias("UsuarioId"))


STUDENTS_SQL = "SELECT CAST(c_custkey AS INTEGER) AS Id, CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey - CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END + 20000000 AS VARCHAR) END AS NumeroDocumento, 'Viejo Nombre' AS NombreCompleto, CAST(NULL AS VARCHAR) AS FechaNacimiento, CASE WHEN c_custkey % 2 = 0 THEN 'Femenino' END AS Sexo, 'Tunja' AS LugarNacimiento, '' AS Nacionalidad, 'B+' AS TipoSangre, 'Archivo' AS Programa, CAST(c_custkey % 30 AS INTEGER) AS UsuarioId FROM customer"


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """programa, known before anything arrives."""
    return spark.createDataFrame([(1, "Sistemas"), (2, "Redes"), (3, "Redes")], "id int, nombre string")


PROGRAMS_SQL = "SELECT * FROM (VALUES (1, 'Sistemas'), (2, 'Redes'), (3, 'Redes')) AS p(id, nombre)"
FIXTURES = {"raw": (raw_fields, RAW_SQL), "card": (card_text, CARD_SQL), "words": (words_raw, WORDS_SQL), "candidates": (candidates, CANDIDATES_SQL), "extractions": (extractions, EXTRACTIONS_SQL), "users": (users, USERS_SQL), "students": (students, STUDENTS_SQL), "programs": (programs, PROGRAMS_SQL)}

"""Consolidation of extractions into people, programmes and documents, set-wise and in order of arrival."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import text as T

#: Columns of a student that an arrival may fill, by the extraction's field.
FILLED = {
    "nombre_completo": "NombreCompleto", "fecha_nacimiento": "FechaNacimiento", "sexo": "Sexo",
    "lugar_nacimiento": "LugarNacimiento", "nacionalidad": "Nacionalidad", "tipo_sangre": "TipoSangre",
}


def defaults(extractions: DataFrame) -> DataFrame:
    """Fills tipo_sangre from rh and nombre_completo from surnames and names, where those columns are there."""
    out, have = extractions, set(extractions.columns)
    if {"rh", "tipo_sangre"} <= have:
        out = out.withColumn("tipo_sangre", F.coalesce(T.some(F.col("tipo_sangre")), F.col("rh")))
    if {"apellidos", "nombres", "nombre_completo"} <= have:
        joined = T.strip(F.concat(T.final(F.col("apellidos")), F.lit(" "), T.final(F.col("nombres"))))
        out = out.withColumn("nombre_completo", F.coalesce(T.some(F.col("nombre_completo")), joined))
    return out


def lookup(table: DataFrame, column: str, value: object, key: str) -> DataFrame:
    """At most one row with a value, of the smallest key."""
    return table.filter(F.col(column) == value).orderBy(key).limit(1)


def first_by(table: DataFrame, column: str, key: str) -> DataFrame:
    """Of each value of a column the row of the smallest key."""
    row = F.struct(key, *(c for c in table.columns if c != key))
    return table.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.min(row).alias("r")).select("r.*")


def known_users(extractions: DataFrame, users: DataFrame) -> DataFrame:
    """The arrivals whose user exists."""
    return extractions.join(users.select(F.col("Id").alias("usuario_id")).distinct(), "usuario_id", "left_semi")


def unknown_users(extractions: DataFrame, users: DataFrame) -> DataFrame:
    """The arrivals whose user doesn't."""
    return extractions.join(users.select(F.col("Id").alias("usuario_id")).distinct(), "usuario_id", "left_anti")


def accepted(extractions: DataFrame, users: DataFrame) -> DataFrame:
    """The arrivals that are stored: their user exists and they name a programme, which no document is without."""
    return known_users(extractions.filter("programa IS NOT NULL"), users)


def refused(extractions: DataFrame, users: DataFrame) -> DataFrame:
    """The arrivals that aren't, with `reason`: 'usuario' where the user is unknown, else 'programa'."""
    nameless = known_users(extractions.filter("programa IS NULL"), users)
    return unknown_users(extractions, users).withColumn("reason", F.lit("usuario")).unionByName(nameless.withColumn("reason", F.lit("programa")))


def bounds_of(rows: DataFrame, order: str) -> list[int]:
    """Bounds that cut an order, a column of whole numbers, into a range for every shuffle partition; so many numbers reach the driver."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)]
    return sorted(set(rows.select(F.percentile_approx(order, cuts, max(10_000, 10 * parts)).alias("q")).first()["q"] or [])) if cuts else []


def numbered(rows: DataFrame, order: str, after: DataFrame, key: str, bounds: list[int] | None = None) -> DataFrame:
    """Adds `key`: the largest in `after`, plus each row's rank by `order`, which has no ties.

    Ranks come from counts of ranges of the order, so that no task sees all rows: a row's rank is its rank in its range
    and the sizes of the ranges before. A row finds its range by halving. `bounds` of a table with about the same order
    save a pass over `rows`; any bounds give the same ranks.
    """
    bounds = bounds_of(rows, order) if bounds is None else bounds
    # Exploded, since of a plain column Spark infers that the ranges of `sizes` are the same function of `order`. `sizes` has no
    # such column, which Spark 4.1 overlooks if its id in the plan is that of a lambda variable in canonical form (7, 8 or 10).
    cut = rows.select("*", F.explode(F.array(range_of(F.col(order), bounds))).alias("_range"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    base = after.agg(F.coalesce(F.max(key), F.lit(0)).alias("_max"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return cut.withColumn("_rank", rank).join(F.broadcast(sizes), "_range").crossJoin(F.broadcast(base)).withColumn(key, (F.col("_max") + F.col("_base") + F.col("_rank")).cast(after.schema[key].dataType)).drop("_range", "_rank", "_base", "_max")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below a whole number: one array and a step for each of its halvings, however many there are."""
    if not bounds:
        return F.lit(0)
    # A text that is split makes one literal; a literal for each bound makes a plan as large as the list.
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    further = lambda n, step: F.when((n + step <= len(bounds)) & (F.get(listed, n + step - 1) < value), n + step).otherwise(n)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def upsert_students(extractions: DataFrame, students: DataFrame) -> DataFrame:
    """The students after all arrivals: Id, NumeroDocumento and the rest.

    Arrivals of a number fold in their order onto the student that has it (of the smallest Id) or onto the first of
    them; a field keeps its last value that isn't empty, Programa the last one, UsuarioId the first. An arrival without
    a number is always a new student. New students are numbered in order of arrival.
    """
    updated, added = _upserted(extractions, students)
    return updated.unionByName(added.drop("_seq"))


def _upserted(extractions: DataFrame, students: DataFrame, bounds: list[int] | None = None, after: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The students there were, brought up to date, and the new ones with `_seq`, the arrival that made each, numbered on from `after` (the students themselves)."""
    number = T.some(T.strip(F.col("numero_documento")))
    x = extractions.withColumn("_number", number)
    last = lambda f: F.max_by(f, F.when(T.some(F.col(f)).isNotNull(), F.col("arrival_seq")))
    folded = x.filter("_number IS NOT NULL").groupBy("_number").agg(
        F.min("arrival_seq").alias("_first"), *(last(f).alias(f"_{c}") for f, c in FILLED.items()),
        F.max_by("programa", "arrival_seq").alias("_Programa"), F.min_by("usuario_id", "arrival_seq").alias("_UsuarioId"),
        *(F.min_by(f, "arrival_seq").alias(f"_first_{c}") for f, c in FILLED.items()),
    )
    target = first_by(students, "NumeroDocumento", "Id").select(F.col("Id").alias("_id"), F.col("NumeroDocumento").alias("_known"))
    matched = folded.join(target, F.col("_number") == F.col("_known"), "left")
    old = students.join(matched.filter("_id IS NOT NULL"), F.col("Id") == F.col("_id"), "left")
    updated = old.select(
        "Id", "NumeroDocumento", *(F.coalesce(f"_{c}", c).alias(c) for c in FILLED.values()),
        F.when(F.col("_id").isNotNull(), F.col("_Programa")).otherwise(F.col("Programa")).alias("Programa"), "UsuarioId",
    )
    new = matched.filter("_id IS NULL").select(
        F.col("_first").alias("_seq"), F.col("_number").alias("NumeroDocumento"),
        *(F.coalesce(F.col(f"_{c}"), F.lit("")).alias(c) for c in FILLED.values()), F.col("_Programa").alias("Programa"), F.col("_UsuarioId").alias("UsuarioId"),
    )
    nameless = x.filter("_number IS NULL").select(
        F.col("arrival_seq").alias("_seq"), F.lit(None).cast("string").alias("NumeroDocumento"),
        *(F.coalesce(F.col(f), F.lit("")).alias(c) for f, c in FILLED.items()), F.col("programa").alias("Programa"), F.col("usuario_id").alias("UsuarioId"),
    )
    return updated, numbered(new.unionByName(nameless), "_seq", students if after is None else after, "Id", bounds_of(extractions, "arrival_seq") if bounds is None else bounds)


def student_changes(extractions: DataFrame, students: DataFrame, after: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """The students that the arrivals change or make, alone, with `_seq` of those they make (null for others).

    `students` are those that hold the arrivals' numbers; others may be among them, or not. `after` has the largest Id.
    """
    held = extractions.select(T.some(T.strip(F.col("numero_documento"))).alias("NumeroDocumento")).distinct()
    changed, added = _upserted(extractions, first_by(students, "NumeroDocumento", "Id").join(held, "NumeroDocumento", "left_semi").select(*students.columns), bounds, after)
    return changed.withColumn("_seq", F.lit(None).cast("long")).unionByName(added.withColumn("_seq", F.col("_seq").cast("long")))


def ensure_programs(extractions: DataFrame, programs: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """The programmes after all arrivals: unknown names are added in order of arrival."""
    return programs.select("id", "nombre").unionByName(new_programs(extractions, programs, programs, bounds))


def new_programs(extractions: DataFrame, programs: DataFrame, after: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """The programmes that the arrivals add; `programs` are those of their names, `after` has the largest id."""
    fresh = extractions.filter("programa IS NOT NULL").groupBy(F.col("programa").alias("nombre")).agg(F.min("arrival_seq").alias("_seq"))
    fresh = fresh.join(programs.select("nombre").distinct(), "nombre", "left_anti")
    return numbered(fresh, "_seq", after, "id", bounds_of(extractions, "arrival_seq") if bounds is None else bounds).select("id", "nombre")


def append_documents(extractions: DataFrame, students: DataFrame, programs: DataFrame, documents: DataFrame, uploaded: Column, made: DataFrame | None = None, bounds: list[int] | None = None) -> DataFrame:
    """The new rows of documento: every arrival with its student, programme and user. Arrivals without a programme are none (see `refused`).

    `students` and `programs` are those after the arrivals. A student without a number belongs to the arrival that
    made it: `made` (_seq, Id) tells which; without it the k-th latest such arrival made the k-th newest such student.
    """
    x = numbered(extractions.filter("programa IS NOT NULL").withColumn("_number", T.some(T.strip(F.col("numero_documento")))), "arrival_seq", documents, "Id", bounds)
    named = first_by(students, "NumeroDocumento", "Id").select(F.col("Id").alias("EstudianteId"), F.col("NumeroDocumento").alias("_number"))
    program = first_by(programs, "nombre", "id").select(F.col("id").alias("ProgramaId"), F.col("nombre").alias("programa"))
    with_number = x.filter("_number IS NOT NULL").join(named, "_number")
    if made is None:
        zero = students.limit(0).select(F.lit(0).alias("_k"))
        by_age = numbered(students.filter("NumeroDocumento IS NULL").withColumn("_minus", -F.col("Id")), "_minus", zero, "_k").select("_k", F.col("Id").alias("EstudianteId"))
        orphans = numbered(x.filter("_number IS NULL").withColumn("_minus", -F.col("arrival_seq")), "_minus", zero, "_k")
        without = orphans.join(by_age, "_k").drop("_k", "_minus")
    else:
        without = x.filter("_number IS NULL").join(made.select(F.col("_seq").alias("arrival_seq"), F.col("Id").alias("EstudianteId")), "arrival_seq")
    done = with_number.unionByName(without).join(program, "programa")
    return done.select(
        "Id", "EstudianteId", "ProgramaId", F.col("usuario_id").alias("UsuarioId"), F.lit("Cedula").alias("TipoDocumento"), F.col("archivo").alias("Archivo"), uploaded.alias("FechaSubida"),
    )


@dataclass
class Tables:
    students: DataFrame
    programs: DataFrame
    documents: DataFrame
    rejected: DataFrame


def consolidate(extractions: DataFrame, users: DataFrame, students: DataFrame, programs: DataFrame, documents: DataFrame, uploaded: Column) -> Tables:
    """All four tables' next state from a batch of arrivals; `documents` holds the new rows only."""
    x = accepted(defaults(extractions), users)
    bounds = bounds_of(extractions, "arrival_seq")  # one pass over the arrivals serves all three numberings
    updated, added = _upserted(x, students, bounds)
    s, p = updated.unionByName(added.drop("_seq")), ensure_programs(x, programs, bounds)
    made = added.filter("NumeroDocumento IS NULL").select("_seq", "Id")
    return Tables(s, p, append_documents(x, s, p, documents, uploaded, made, bounds), refused(extractions, users))


def verified(documents: DataFrame, students: DataFrame, programs: DataFrame, users: DataFrame, written: DataFrame) -> DataFrame:
    """(Id, stored, student, program, user): of each document of a batch whether the tables, read again after the write, have it and all that it refers to.

    `documents` are the rows that were to be written, `written` the table as it is now. The four lookups are semi joins
    on keys, so a document shows once however often a table repeats a key.
    """
    there = lambda df, key, to: df.select(F.col(key).alias(to)).distinct().withColumn(f"_{to}", F.lit(True))
    out = documents.select("Id", "EstudianteId", "ProgramaId", "UsuarioId")
    for table, key, to in ((written, "Id", "Id"), (students, "Id", "EstudianteId"), (programs, "id", "ProgramaId"), (users, "Id", "UsuarioId")):
        out = out.join(there(table, key, to), to, "left")
    flags = {"stored": "_Id", "student": "_EstudianteId", "program": "_ProgramaId", "user": "_UsuarioId"}
    return out.select("Id", *(F.col(c).isNotNull().alias(n) for n, c in flags.items()))


def register(requests: DataFrame, users: DataFrame) -> DataFrame:
    """New users from requests (seq, email, name, last_name, password_hash): the first of each address that no user has."""
    fresh = requests.groupBy(F.col("email").alias("Email")).agg(F.min(F.struct("seq", "name", "last_name", "password_hash")).alias("r"))
    fresh = fresh.join(users.select("Email").distinct(), "Email", "left_anti").select(F.col("r.seq").alias("_seq"), "Email", F.col("r.name").alias("Nombre"), F.col("r.last_name").alias("Apellido"), F.col("r.password_hash").alias("Password"))
    return numbered_users(fresh, users, bounds_of(requests, "seq"))


def numbered_users(fresh: DataFrame, after: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """Users from the requests that make one (_seq, Email, Nombre, Apellido, Password), numbered on from the largest Id of `after` in their order."""
    return numbered(fresh, "_seq", after, "Id", bounds).select("Id", "Nombre", "Apellido", "Email", "Password", F.lit(0).alias("ConteoIngresos"))


def count_logins(users: DataFrame, logins: DataFrame) -> DataFrame:
    """`users` with ConteoIngresos raised by the verified logins (email, verified) of each; users without any keep theirs."""
    n = logins.filter("verified").groupBy(F.col("email").alias("Email")).agg(F.count(F.lit(1)).alias("_n"))
    raised = F.when(F.col("_n").isNotNull(), F.coalesce("ConteoIngresos", F.lit(0)) + F.col("_n").cast("int")).otherwise(F.col("ConteoIngresos"))
    return users.join(n, "Email", "left").withColumn("ConteoIngresos", raised).drop("_n").select(*users.columns)

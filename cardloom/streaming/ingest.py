"""Continuous consolidation: a stream of extractions, one published version of the tables for each batch.

A batch reads only the buckets that hold its numbers and programmes, writes the rows that it changes or adds, and is
published by a manifest (see `store`). A batch that was published before is skipped; one that broke is done again from
the version before it, with the same rows and numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardloom.functions import text as T
from cardloom.operators import records
from cardloom.streaming.store import Store, Table, columns

STUDENTS = columns("Id int, NumeroDocumento string, NombreCompleto string, FechaNacimiento string, Sexo string, LugarNacimiento string, Nacionalidad string, TipoSangre string, Programa string, UsuarioId int")
TABLES = {
    "students": Table(STUDENTS, key="Id", bucket_by="NumeroDocumento", number="Id"),
    "programs": Table(columns("id int, nombre string"), bucket_by="nombre", number="id"),
    "documents": Table(columns("Id int, EstudianteId int, ProgramaId int, UsuarioId int, TipoDocumento string, Archivo string, FechaSubida timestamp"), number="Id"),
    "rejected": Table(columns("arrival_seq long, usuario_id int, programa string, archivo string, reason string")),
}


def open_store(spark: SparkSession, root: str, students: DataFrame, programs: DataFrame, **options: int) -> Store:
    """The store under `root`, with version 0 of these tables if nothing is published there."""
    store = Store(spark, root, TABLES, **options)
    if not store.versions():
        store.publish(0, {"students": store.write("students", students, 0), "programs": store.write("programs", programs, 0)})
    return store


def _looked_up(store: Store, name: str, base, values: DataFrame) -> DataFrame:  # noqa: ANN001
    """The rows of a table in the buckets of some values (one column); at most as many bucket numbers as there are reach the driver."""
    touched = [r[0] for r in values.select(store.bucket(F.col(values.columns[0]))).distinct().collect()]
    return store.read(name, base, touched)


def apply_batch(store: Store, users: DataFrame, uploaded: Column) -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` runs: consolidates a batch onto the newest version."""

    def run(batch: DataFrame, batch_id: int) -> None:
        base, version = store.manifest(), batch_id + 1
        if version <= base.version:
            return
        spark = batch.sparkSession
        arrivals = batch.persist(StorageLevel.DISK_ONLY)
        x = records.accepted(records.defaults(arrivals), users).persist(StorageLevel.DISK_ONLY)
        last = lambda name, key: spark.createDataFrame([(base.last.get(name, 0),)], f"{key} int")
        try:
            bounds = records.bounds_of(x, "arrival_seq")
            number = T.some(T.strip(F.col("numero_documento")))
            held = _looked_up(store, "students", base, x.select(number.alias("n")).filter("n IS NOT NULL"))
            changed = records.student_changes(x, held, last("students", "Id"), bounds).persist(StorageLevel.DISK_ONLY)
            known = _looked_up(store, "programs", base, x.select("programa")).join(x.select(F.col("programa").alias("nombre")).distinct(), "nombre", "left_semi")
            students = store.write("students", changed, version)
            programs = store.write("programs", records.new_programs(x, known, last("programs", "id"), bounds), version)
            made = changed.filter("NumeroDocumento IS NULL").select("_seq", "Id")
            documents = records.append_documents(x, store.segment("students", students), known.unionByName(store.segment("programs", programs)), last("documents", "Id"), uploaded, made, bounds)
            store.publish(version, {
                "students": students, "programs": programs, "documents": store.write("documents", documents, version),
                "rejected": store.write("rejected", records.refused(arrivals, users), version),
            }, base)
        finally:
            for kept in (arrivals, x):
                kept.unpersist()

    return run


def consolidate_stream(arrivals: DataFrame, store: Store, users: DataFrame, checkpoint: str, *, uploaded: Column | None = None, once: bool = False) -> StreamingQuery:
    """Starts the stream; with `once` it takes what is there and ends. Version 0 of the tables must be published."""
    writer = arrivals.writeStream.foreachBatch(apply_batch(store, users, F.current_timestamp() if uploaded is None else uploaded)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def consolidate_in_batches(extractions: DataFrame, users: DataFrame, store: Store, *, batches: int, uploaded: Column) -> Store:
    """Applies extractions to a store in so many batches, cut by their order of arrival, as a stream would bring them."""
    cuts = records.bounds_of(extractions, "arrival_seq")
    picked = sorted({cuts[len(cuts) * i // batches] for i in range(1, batches)}) if cuts else []
    run = apply_batch(store, users, uploaded)
    for i, (low, high) in enumerate(zip([None, *picked], [*picked, None], strict=True)):
        part = extractions
        if low is not None:
            part = part.filter(F.col("arrival_seq") > low)
        if high is not None:
            part = part.filter(F.col("arrival_seq") <= high)
        run(part, i)
    return store

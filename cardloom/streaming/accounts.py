"""Registration and login counting as streams with keyed state, so that a batch reads no table of users.

An address is registered once: the state of its key says whether a user has it, begun from the users there are. Login
counts are a running aggregate by address, which Spark merges inside the tasks first. What a batch brings goes to a store
of its own, whose manifest has the version of the last batch that counts, and the largest Id to number on from.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cardloom.operators import records
from cardloom.streaming.store import Store, Table, columns

USERS = {"users": Table(columns("Id int, Nombre string, Apellido string, Email string, Password string, ConteoIngresos int"), bucket_by="Email", number="Id")}
COUNTS = {"logins": Table(columns("Email string, n long"), key="Email", bucket_by="Email")}
_FRESH = "_seq long, Email string, Nombre string, Apellido string, Password string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Registrations(StatefulProcessor):
    """Emits the first request of an address that nobody has; later ones, in this batch or another, find it taken."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "taken boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if not self.taken.exists():
            first = min(rows, key=lambda r: r.seq)
            self.taken.update((True,))
            yield Row(_seq=first.seq, Email=key[0], Nombre=first.name, Apellido=first.last_name, Password=first.password_hash)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        self.taken.update((True,))

    def close(self) -> None:
        pass


def _firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each address the first request of a batch: a frequent address reaches its state as one row a batch."""
    for batch in batches:
        yield batch.sort_values("seq", kind="stable").drop_duplicates("email")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """State of named variables needs Spark's RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def register_stream(requests: DataFrame, store: Store, users: DataFrame, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """New users from a stream of requests (seq, email, name, last_name, password_hash), as `records.register` makes them.

    `users` (Id, Email) are those before the first batch: they begin the state and the numbers, and aren't read again.
    Requests without an address are none. A later batch has later requests.
    """
    spark, begun = requests.sparkSession, store.manifest()
    if begun.version < 0:
        begun.last["users"] = users.agg(F.coalesce(F.max("Id"), F.lit(0))).first()[0]
        store.publish(0, {}, begun)

    def run(batch: DataFrame, batch_id: int) -> None:
        base, version = store.manifest(), batch_id + 1
        if version <= base.version:
            return
        fresh = batch.persist(StorageLevel.DISK_ONLY)  # the state is asked once
        after = spark.createDataFrame([(base.last.get("users", 0),)], "Id int")
        store.publish(version, {"users": store.write("users", records.numbered_users(fresh, after), version)}, base)
        fresh.unpersist()

    named = requests.filter("email IS NOT NULL").select("seq", "email", "name", "last_name", "password_hash")
    with _state_store(spark):
        taken = users.select(F.col("Email").alias("email")).filter("email IS NOT NULL").distinct().groupBy("email")
        fresh = named.mapInPandas(_firsts, named.schema).groupBy("email").transformWithState(statefulProcessor=Registrations(), outputStructType=_FRESH, outputMode="Append", timeMode="None", initialState=taken)
        writer = fresh.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def count_stream(logins: DataFrame, store: Store, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Counts of verified logins (email, verified) by address, kept up in `store`; a batch writes the addresses that it raises."""

    def run(batch: DataFrame, batch_id: int) -> None:
        base, version = store.manifest(), batch_id + 1
        if version > base.version:
            store.publish(version, {"logins": store.write("logins", batch, version)}, base)

    counts = logins.filter("verified AND email IS NOT NULL").groupBy(F.col("email").alias("Email")).agg(F.count(F.lit(1)).alias("n"))
    with _state_store(logins.sparkSession):
        writer = counts.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def counted(users: DataFrame, logins: DataFrame) -> DataFrame:
    """`users` with ConteoIngresos raised by the counts (Email, n) of a store; as `records.count_logins`."""
    raised = F.when(F.col("n").isNotNull(), F.coalesce("ConteoIngresos", F.lit(0)) + F.col("n").cast("int")).otherwise(F.col("ConteoIngresos"))
    return users.join(logins, "Email", "left").withColumn("ConteoIngresos", raised).select(*users.columns)

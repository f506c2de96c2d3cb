"""Where jobs keep what they cut from their lineage, and how rows reach Python in bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot with more rows than one in so many of all; so at most as many keys are hot, and only those are broadcast.
HOT_KEYS = 20_000
#: Bits of a broadcast filter for each of its keys, and the least and most in all (128 KB, 8 MB).
KEY_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder; a cluster without it is an error.
    """
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("cardloom.shared.dir", None)
    if at:
        return at.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="cardloom-")
    spark.conf.set("cardloom.shared.dir", at)
    return at


def staged(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    for held in _SCRATCH[-1:]:
        held.append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes at its end what `staged` wrote in it, but for what is taken off the list; for work whose outcome is written before the end."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        for df in _SCRATCH.pop():
            discard(df)


def discard(df: DataFrame) -> None:
    """Deletes what `staged` wrote for a DataFrame that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, *, least: int = 1_000) -> DataFrame:
    """`rows` with the columns of `table` that have one row a `key`, null where it has none; `weight` is how many rows a key has.

    Rows of hot keys meet their table row in a broadcast of at most `HOT_KEYS` rows and are then dealt by their place,
    so no task gets a whole hot key. `table` is evaluated several times and should be staged.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    value = F.struct(*(F.col(f"`{c}`") for c in table.columns if c != key))
    is_hot = F.col(weight) > max(least, total // HOT_KEYS)
    hot = table.filter(is_hot).select(F.col(key).alias("_hot_key"), value.alias("_hot"))
    cold = table.filter(~is_hot).select(F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_deal"), value.alias("_cold"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    met = met.withColumn("_deal", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id()))
    both = met.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_deal") == F.col("_cold_deal")), "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), *(found[c].alias(c) for c in table.columns if c != key))


def sifted(rows: DataFrame, key: Column, keys: DataFrame, *, bits: int | None = None) -> DataFrame:
    """`rows` with a column `maybe`, false only where the long `key` is none of `keys` (key): what is false needs no join.

    Told by one bit of a broadcast bitmap, so that wide rows stay where they are. The bitmap has at most `MOST_BITS`; the more
    keys, the more rows pass that have none of them. `keys` is evaluated twice and should be staged.
    """
    bits = bits or min(MOST_BITS, max(LEAST_BITS, KEY_BITS * keys.count()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    slots = keys.select(slot(F.col("key")).alias("_slot")).distinct()
    maps = slots.select(F.bitmap_bucket_number("_slot").alias("_bucket"), F.bitmap_bit_position("_slot").alias("_bit")).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    met = rows.withColumn("_slot", slot(key)).join(F.broadcast(maps), F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")
    bit = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), found.alias("maybe"))


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches holding at most `limit` bytes of a text column, or one row if that alone is longer."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch in UTF-8; null counts as empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]

"""Tables as Parquet segments under a folder: a batch writes what it changed, and a manifest names the files that count.

A segment holds the rows that one batch added or changed, in folders by bucket, a hash of the column that rows are looked
up by. A keyed table shows of every key the row of the newest segment that has it (merge on read); other tables show all
rows. A manifest is one small file for each version; it is written last and under a name of its own, so a batch shows
whole or not at all, and of two writers of a version one fails. Segments of one level are merged into one of the next
when there are `fan` of them, so a row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

BUCKETS, FAN, KEEP = 16, 4, 3
#: Keys of newer segments are broadcast to the oldest one up to this many (manifests count rows); beyond it both are shuffled.
MOST_BROADCAST = 100_000


_TYPES = {"int": IntegerType(), "long": LongType(), "string": StringType(), "timestamp": TimestampType()}


def columns(names: str) -> StructType:
    """A schema from "name type, name type"; unlike Spark's own parser it needs no session."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in names.split(","))])


@dataclass(frozen=True)
class Table:
    """How a table is kept: its columns, its key (none: rows only come to it) and what its buckets are hashes of."""

    schema: StructType
    key: str | None = None
    bucket_by: str | None = None
    #: A column of whole numbers whose largest value the manifest keeps, to number on from it.
    number: str | None = None


@dataclass
class Manifest:
    """One version: the segments of every table, oldest first, the largest numbers, and the versions that can still be read."""

    version: int
    segments: dict[str, list[dict]] = field(default_factory=dict)
    last: dict[str, int] = field(default_factory=dict)
    kept: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Manifest:
        return cls(**json.loads(text))

    def paths(self) -> set[str]:
        return {s["path"] for listed in self.segments.values() for s in listed}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir")
    if not at:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="cardloom-")
    return f"{at.rstrip('/')}/store/{uuid.uuid4().hex}"


class Store:
    """The tables under a root folder."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], *, buckets: int = BUCKETS, fan: int = FAN, keep: int = KEEP):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self.buckets, self.fan, self.keep = buckets, fan, keep

    # Files

    def _fs(self, path: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _text(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """The versions that there are manifests of, by one listing."""
        fs, at = self._fs(f"{self.root}/manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, the newest one's as a rule; without any version an empty one of version -1."""
        if version is None:
            found = self.versions()
            if not found:
                return Manifest(-1)
            version = found[-1]
        return Manifest.of(self._text(self._manifest_path(version)))

    def commit(self, manifest: Manifest) -> None:
        """Makes a version count. Its file is renamed into place, which fails if another writer was first."""
        text, aside = json.dumps(manifest.__dict__), f"{self.root}/manifests/_{uuid.uuid4().hex}"
        fs, at = self._fs(aside)
        stream = fs.create(at, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, to = self._fs(self._manifest_path(manifest.version))
        if fs.exists(to) or not fs.rename(at, to):
            fs.delete(at, False)
            raise FileExistsError(f"version {manifest.version} of {self.root} has been published by another writer")

    # Reading

    def bucket(self, value) -> F.Column:  # noqa: ANN001
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _segment(self, name: str, segment: dict, buckets: Iterable[int] | None) -> DataFrame:
        table = self.tables[name]
        df = self.spark.read.schema(StructType([*table.schema, StructField("bucket", IntegerType())])).parquet(f"{self.root}/{segment['path']}")
        return df if buckets is None else df.filter(F.col("bucket").isin(list(buckets)))

    def read(self, name: str, manifest: Manifest | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a manifest, the newest one by default; with `buckets`, the rows of those alone, whose files alone are read."""
        manifest = manifest or self.manifest()
        if manifest.version < 0:
            raise FileNotFoundError(f"nothing is published under {self.root}")
        return self._merged(name, manifest.segments.get(name, []), buckets)

    def lookup(self, name: str, value: object, order: str, manifest: Manifest | None = None) -> DataFrame:
        """At most one row whose `bucket_by` column has a value, of the smallest `order`: of each segment one bucket is read, and of it what Parquet's statistics and Bloom filters let through."""
        column = self.tables[name].bucket_by
        bucket = self.spark.range(1).select(self.bucket(F.lit(value).cast("string"))).first()[0]
        return self.read(name, manifest, [bucket]).filter(F.col(column) == F.lit(value)).orderBy(order).limit(1)

    def _merged(self, name: str, segments: list[dict], buckets: Iterable[int] | None = None) -> DataFrame:
        table, buckets = self.tables[name], None if buckets is None else list(buckets)
        if not segments:
            return self.spark.createDataFrame([], table.schema)
        parts = [self._segment(name, s, buckets) for s in segments]
        if table.key is None or len(parts) == 1:
            out = parts[0]
            for more in parts[1:]:
                out = out.unionByName(more)
            return out.select(*table.schema.names)
        # What the newer segments have of a key, its newest row, and of the oldest the keys that they don't have.
        row = F.struct(*table.schema.names)
        newer = parts[1].withColumn("_at", F.lit(1))
        for i, more in enumerate(parts[2:], 2):
            newer = newer.unionByName(more.withColumn("_at", F.lit(i)))
        if len(parts) > 2:
            newer = newer.groupBy(table.key).agg(F.max_by(row, "_at").alias("r")).select("r.*")
        keys = newer.select(table.key)
        if sum(s["rows"] for s in segments[1:]) <= MOST_BROADCAST:
            keys = F.broadcast(keys)
        return parts[0].join(keys, table.key, "left_anti").select(*table.schema.names).unionByName(newer.select(*table.schema.names))

    # Writing

    def write(self, name: str, rows: DataFrame, version: int, level: int = 0) -> dict | None:
        """Writes a segment that no manifest names yet and says what it is; None if it has no rows. Every try has a folder of its own."""
        table = self.tables[name]
        path = f"{name}/version={version}/level={level}-{uuid.uuid4().hex[:12]}"
        # Rows without a value to be looked up by go by their number, so that they aren't all in one bucket.
        known = [F.col(c).cast("string") for c in (table.bucket_by, table.number) if c]
        by = self.bucket(F.coalesce(*known, F.lit(""))) if known else F.lit(0)
        # A task has whole buckets, so that a bucket is one file, if its rows are few; AQE splits what is large.
        shaped = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema)).withColumn("bucket", by).hint("rebalance", F.col("bucket"))
        bloom = {f"parquet.bloom.filter.enabled#{table.bucket_by}": "true"} if table.bucket_by else {}
        shaped.write.options(**bloom).partitionBy("bucket").parquet(f"{self.root}/{path}")
        written = self.spark.read.schema(StructType([*table.schema, StructField("bucket", IntegerType())])).parquet(f"{self.root}/{path}")
        largest = F.max(table.number) if table.number else F.lit(None)
        seen = written.agg(F.count(F.lit(1)).alias("n"), largest.cast("long").alias("last")).first()
        if not seen.n:
            self._delete(path)
            return None
        return {"path": path, "version": version, "level": level, "rows": seen.n, "last": seen.last}

    def segment(self, name: str, segment: dict | None) -> DataFrame:
        """The rows of a segment that was just written, read back."""
        return self._merged(name, [segment] if segment else [])

    def publish(self, version: int, written: dict[str, dict | None], base: Manifest | None = None) -> Manifest:
        """The next version: the segments of `base` (the newest by default) and the written ones, merged where a level is full."""
        base = base or self.manifest()
        after = Manifest(version, {n: list(s) for n, s in base.segments.items()}, dict(base.last), [*base.kept, version])
        expired, after.kept = after.kept[: -self.keep], after.kept[-self.keep :]
        made = []
        for name, segment in written.items():
            if segment:
                made.append(segment["path"])
                after.segments.setdefault(name, []).append({k: v for k, v in segment.items() if k != "last"})
                if segment["last"] is not None:
                    after.last[name] = max(after.last.get(name, 0), segment["last"])
                made += self._compact(name, after)
        self.commit(after)
        # What was merged at once was never named.
        for path in set(made) - after.paths():
            self._delete(path)
        self._expire(expired, after)
        return after

    def _compact(self, name: str, manifest: Manifest) -> list[str]:
        """Merges the newest level while it is full; returns the paths that it wrote."""
        listed, made = manifest.segments[name], []
        while True:
            level = listed[-1]["level"]
            run = [s for s in listed if s["level"] == level]  # levels fall from old to new, so these are the newest ones
            if len(run) < self.fan:
                return made
            merged = self.write(name, self._merged(name, run), run[-1]["version"], level + 1)
            made.append(merged["path"])
            listed[len(listed) - len(run) :] = [{k: v for k, v in merged.items() if k != "last"}]

    def _delete(self, path: str) -> None:
        fs, at = self._fs(f"{self.root}/{path}")
        fs.delete(at, True)

    def _expire(self, expired: list[int], after: Manifest) -> None:
        """Deletes the manifests of versions that can't be read any more, and the segments that only they name."""
        if not expired:
            return
        live = after.paths().union(*(self.manifest(v).paths() for v in after.kept[:-1]))
        for v in expired:
            for path in self.manifest(v).paths() - live:
                self._delete(path)
            self._delete(f"manifests/{v:012d}.json")

    def vacuum(self) -> int:
        """Deletes what broken tries have left in versions up to the newest one; nobody may be writing. Returns how many segments went."""
        newest, gone = self.manifest(), 0
        live = set().union(*(self.manifest(v).paths() for v in newest.kept))
        for name in self.tables:
            fs, at = self._fs(f"{self.root}/{name}")
            for folder in (s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else ())):
                for path in (f"{name}/{folder.getName()}/{s.getPath().getName()}" for s in fs.listStatus(folder)):
                    if int(folder.getName().removeprefix("version=")) <= newest.version and path not in live:
                        self._delete(path)
                        gone += 1
        return gone

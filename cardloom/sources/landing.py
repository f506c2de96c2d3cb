"""Files that land and are read again: a sink with a commit protocol and a source of their pages with pushed filters.

Both reach their files through Arrow's file systems (local disks, HDFS, object stores); for other stores `recognise.pages`
does the same over Spark's binary files, without the pushed filters. `register` makes both known to a session.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from cardloom.sources.recognise import Recogniser

_ASIDE = "_landing"
#: Files up to so many bytes together make a partition of the source.
PARTITION_BYTES = 64 << 20
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Makes the sink `landing` and the source `card_pages` known, and lets filters reach Python sources."""
    spark.dataSource.register(Landing)
    spark.dataSource.register(CardPages)
    spark.conf.set(_PUSHDOWN, "true")


def _at(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    found, path = arrow_fs.FileSystem.from_uri(uri)
    return found, path.rstrip("/")


def _is_file(store: arrow_fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == arrow_fs.FileType.File


def _digest(store: arrow_fs.FileSystem, path: str) -> str:
    sha = hashlib.sha256()
    with store.open_input_stream(path) as stream:
        while piece := stream.read(1 << 20):
            sha.update(piece)
    return sha.hexdigest()


# The sink


def land(files: DataFrame, root: str) -> None:
    """Writes every `content` of `files` (path, content) to its `path` under `root`, all or none.

    A task writes aside; only what the tasks that count have written is moved into place when all are done, so retried,
    speculative and failed tasks leave nothing. A file that is there with the same bytes has landed before; one with other
    bytes, or two different files of one path, are a clash, which is reported before anything is moved.
    """
    register(files.sparkSession)
    files.select("path", "content").write.format("landing").mode("append").save(root)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class Landing(DataSource):
    """The sink of `land`."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> LandingWriter:
        return LandingWriter(self.options["path"])


class LandingWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _at(self.root)
        folder, n = f"{root}/{_ASIDE}/{self.job}/{uuid.uuid4().hex}", 0
        for row in iterator:
            parts = (row.path or "").split("/")
            if not row.path or ".." in parts or "" in parts or parts[0] == _ASIDE:
                raise ValueError(f"not a path under the landing folder: {row.path!r}")
            to = f"{folder}/{row.path}"
            if _is_file(store, to):
                raise FileExistsError(f"two files of one task land at {row.path}")
            store.create_dir(to.rpartition("/")[0], recursive=True)
            with store.open_output_stream(to) as out:
                out.write(bytes(row.content or b""))
            n += 1
        return Written(folder, n)

    def _moves(self, messages: list[WriterCommitMessage | None]) -> Iterator[tuple[str, str, str]]:
        """(from, to, path), a task's folder at a time."""
        store, root = _at(self.root)
        for message in messages:
            if message and message.files:
                for info in store.get_file_info(arrow_fs.FileSelector(message.folder, recursive=True)):
                    if info.type == arrow_fs.FileType.File:
                        path = info.path[info.path.index(message.folder.lstrip("/")) + len(message.folder.lstrip("/")) + 1 :]
                        yield info.path, f"{root}/{path}", path

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _at(self.root)
        seen: dict[str, str] = {}
        clashes = []
        for at, to, path in self._moves(messages):
            other = to if _is_file(store, to) else seen.get(path)
            if other and (store.get_file_info(other).size != store.get_file_info(at).size or _digest(store, other) != _digest(store, at)):
                clashes.append(path)
            seen[path] = at
        if clashes:
            self.abort(messages)
            raise FileExistsError(f"{len(clashes)} files clash with others of their path, {', '.join(sorted(clashes)[:5])}; nothing landed")
        for at, to, _ in self._moves(messages):
            if not _is_file(store, to):
                store.create_dir(to.rpartition("/")[0], recursive=True)
                store.move(at, to)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Deletes what the job has written aside."""
        store, root = _at(self.root)
        store.delete_dir_contents(f"{root}/{_ASIDE}/{self.job}", missing_dir_ok=True)
        if store.get_file_info(f"{root}/{_ASIDE}/{self.job}").type == arrow_fs.FileType.Directory:
            store.delete_dir(f"{root}/{_ASIDE}/{self.job}")


# The source


def card_pages(spark: SparkSession, path: str, recogniser: Recogniser, *, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(doc_id, page_no, text, error) of the pages of all files under `path`, as `recognise.pages` has them.

    `doc_id` is the file's path under `path`; empty files, which Spark's own source leaves out, are read too. Filters on page_no (=, <, <=, IN) end the reading of a file at the last page
    that they let through, and filters on doc_id leave out other files; files are dealt to partitions by their sizes.
    """
    register(spark)
    pickled = base64.b64encode(cloudpickle.dumps(recogniser)).decode()
    return spark.read.format("card_pages").option("recogniser", pickled).option("partition_bytes", partition_bytes).load(path)


class CardPages(DataSource):
    """The source of `card_pages`."""

    @classmethod
    def name(cls) -> str:
        return "card_pages"

    def schema(self) -> str:
        return "doc_id string, page_no int, text string, error string"

    def reader(self, schema: StructType) -> CardPagesReader:
        return CardPagesReader(self.options)


@dataclass
class Files(InputPartition):
    paths: list[str]


class CardPagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.bytes = options["path"], int(options["partition_bytes"])
        self.recogniser = options["recogniser"]
        self.last: int | None = None
        self.pages: set[int] | None = None
        self.docs: set[str] | None = None

    def _narrow(self, pages: set[int] | None = None, last: int | None = None, docs: set[str] | None = None) -> None:
        if last is not None:
            self.last = last if self.last is None else min(self.last, last)
        if pages is not None:
            self.pages = pages if self.pages is None else self.pages & pages
        if docs is not None:
            self.docs = docs if self.docs is None else self.docs & docs

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what bounds pages or names files; Spark applies the rest to the rows."""
        for f in filters:
            match f:
                case LessThanOrEqual(("page_no",), n):
                    self._narrow(last=n)
                case LessThan(("page_no",), n):
                    self._narrow(last=n - 1)
                case EqualTo(("page_no",), n):
                    self._narrow(pages={n})
                case In(("page_no",), values):
                    self._narrow(pages={v for v in values if v is not None})
                case EqualTo(("doc_id",), name):
                    self._narrow(docs={name})
                case In(("doc_id",), values):
                    self._narrow(docs={v for v in values if v is not None})
                case IsNotNull(("page_no",)) | IsNotNull(("doc_id",)):
                    pass  # they never are
                case _:
                    yield f

    def partitions(self) -> list[InputPartition]:
        store, root = _at(self.root)
        infos = store.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = sorted((i.path, i.size) for i in infos if i.type == arrow_fs.FileType.File and not any(p.startswith(("_", ".")) for p in self._name(i.path, root).split("/")))
        out: list[Files] = []
        total = 0
        for path, size in found:
            if self.docs is not None and self._name(path, root) not in self.docs:
                continue
            if not out or total + size > self.bytes:
                out.append(Files([]))
                total = 0
            out[-1].paths.append(path)
            total += size
        return out or [Files([])]

    @staticmethod
    def _name(path: str, root: str) -> str:
        plain = root.lstrip("/")
        return path[path.index(plain) + len(plain) + 1 :]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _at(self.root)
        recogniser = cloudpickle.loads(base64.b64decode(self.recogniser))
        last = self.last if self.pages is None else min(max(self.pages, default=0), self.last if self.last is not None else 1 << 31)
        schema = pa.schema({"doc_id": pa.string(), "page_no": pa.int32(), "text": pa.string(), "error": pa.string()})
        wanted = lambda n: (self.pages is None or n in self.pages) and (last is None or n <= last)
        for path in partition.paths:
            name, rows = self._name(path, root), []
            try:
                with store.open_input_stream(path) as stream:
                    content = stream.read()
                # A recogniser that yields its pages isn't asked for those behind the last one.
                for n, text in enumerate(islice(recogniser.page_texts(content), last), 1):
                    if wanted(n):
                        rows.append((name, n, text, None))
            except Exception as why:  # noqa: BLE001 - one bad file must not stop the others
                rows = [(name, 1, None, str(why) or type(why).__name__)] if wanted(1) else []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

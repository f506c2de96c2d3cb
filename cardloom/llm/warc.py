"""WARC records and a Merkle fixity audit of their replicas.

An archive holds the records of a range of ids, each in the slot of its id, in order of slot and digest. A slot's node
hashes its records with their byte ranges; ordered ranges of `FANOUT` children hash the byte ranges and hashes of the
level below, up to the archive's root. Ranges count from the start of their parent, so a record that changes its length
moves no sibling's hash, while one that is moved, lost or added changes all nodes above it. An audit compares the roots
of two replicas and then only the children of nodes that differ, down to the records, which are read there alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.shared import HOT_KEYS, staged

SLOTS, FANOUT = 512, 8
LEVELS = 3  # FANOUT ** LEVELS == SLOTS
#: Distinct records of an archive above which it is split into parts by digest, unless one record in `HOT_KEYS` of all are more.
MOST_RECORDS = 4096
PLACE = ["archive", "part"]


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text: header lines, the page, two line ends. Nulls count as empty."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), blank(page_id),
        F.lit(">\r\nWARC-Target-URI: "), blank(url),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(blank(html)).cast("string"),
        F.lit("\r\n\r\n"), blank(html), F.lit("\r\n\r\n"),
    )


def fixity(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, archive, slot, length, leaf, copies): each distinct record with its place, its SHA-256 and how many rows are alike.

    Pages with a null id are spread over archives below zero by their record's digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), record(F.col(id_col), F.col(url_col), F.col(body_col)).alias("r"))
    rows = rows.select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("leaf"))
    spread = F.xxhash64("leaf")
    placed = rows.select(
        "page_id",
        F.when(F.col("page_id").isNull(), -1 - F.pmod(spread, F.lit(1 << 20))).otherwise(F.floor(F.col("page_id") / SLOTS)).cast("long").alias("archive"),
        F.when(F.col("page_id").isNull(), F.pmod(spread, F.lit(SLOTS))).otherwise(F.pmod("page_id", F.lit(SLOTS))).cast("int").alias("slot"),
        "length", "leaf",
    )
    return placed.groupBy("page_id", "archive", "slot", "length", "leaf").agg(F.count(F.lit(1)).alias("copies"))


def placed(ours: DataFrame, theirs: DataFrame, most: int = MOST_RECORDS) -> tuple[DataFrame, DataFrame]:
    """Both replicas' records with `part` and `offset`, the first byte in the archive's part, staged.

    Archives of more than `most` records (repeated ids can fill one slot) are split by digest, in both replicas alike.
    """
    ours, theirs = staged(ours), staged(theirs)
    sizes = ours.groupBy("archive").count().unionAll(theirs.groupBy("archive").count()).groupBy("archive").agg(F.max("count").alias("n"))
    # At most 2 * HOT_KEYS archives can be above the second bound.
    least = max(most, ours.count() // HOT_KEYS, theirs.count() // HOT_KEYS)
    parts = F.broadcast(sizes.filter(F.col("n") > least).select("archive", F.ceil(F.col("n") / least).cast("int").alias("parts")))
    before = Window.partitionBy(*PLACE).orderBy("slot", "leaf", "page_id").rowsBetween(Window.unboundedPreceding, -1)

    def one(records: DataFrame) -> DataFrame:
        part = F.coalesce(F.pmod(F.xxhash64("leaf"), F.col("parts")).cast("int"), F.lit(0))
        return staged(records.join(parts, "archive", "left").withColumn("part", part).drop("parts").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))))

    return one(ours), one(theirs)


def tree(records: DataFrame) -> DataFrame:
    """(level, archive, part, node, start, bytes, hash) from slots (level 0) to roots, staged; an archive's nodes are made in one task.

    A node hashes its children in order, each as its range of bytes from the node's start, and its hash or digest.
    """

    def over(children: DataFrame, node: Column, length: Column, name: Column) -> DataFrame:
        item = F.struct(F.col("start").alias("s"), F.col("node").alias("k"), length.alias("n"), name.alias("h"))
        nodes = children.groupBy(*PLACE, node.alias("at")).agg(F.array_sort(F.collect_list(item)).alias("c"), F.min("start").alias("start"), F.sum(length).alias("bytes"))
        text = F.transform("c", lambda x: F.concat_ws(":", (x["s"] - F.col("start")).cast("string"), x["n"].cast("string"), x["k"], x["h"]))
        return nodes.select(*PLACE, F.col("at").alias("node"), "start", "bytes", F.sha2(F.concat_ws(",", text), 256).alias("hash"))

    dealt = records.repartition(*PLACE)
    leaves = dealt.select(*PLACE, "slot", F.col("offset").alias("start"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("node"), "length", F.concat_ws("*", "leaf", F.col("copies").cast("string")).alias("name"))
    now = over(leaves, F.col("slot"), F.col("length"), F.col("name"))
    out = [now.withColumn("level", F.lit(0))]
    for level in range(1, LEVELS + 1):
        children = now.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int")).withColumn("node", F.col("node").cast("string"))
        now = over(children, F.col("up"), F.col("bytes"), F.col("hash"))
        out.append(now.withColumn("level", F.lit(level)))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return staged(whole)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, part, node) of the slots in which two trees differ, found from the roots down."""
    wrong = None
    for level in range(LEVELS, -1, -1):
        left, right = (t.filter(F.col("level") == level).select(*PLACE, "node", "hash") for t in (a, b))
        if wrong is not None:
            up = wrong.withColumnRenamed("node", "up")
            under = lambda df: df.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int")).join(up, [*PLACE, "up"], "left_semi").drop("up")  # noqa: B023, E731
            left, right = under(left), under(right)
        both = left.withColumnRenamed("hash", "h1").join(right.withColumnRenamed("hash", "h2"), [*PLACE, "node"], "full_outer")
        wrong = staged(both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select(*PLACE, "node"))
    return wrong


def audit(ours: DataFrame, theirs: DataFrame, *, most: int = MOST_RECORDS) -> DataFrame:
    """(page_id, archive, part, slot, offset, length, leaf, copies, held, ok): every distinct record of either replica (see `fixity`).

    `held` is `both`, `ours` or `theirs`; `ok` is true where both hold it, at the same place of its slot and as often. A
    damaged record shows twice, as ours and as theirs. `offset`, `length` and `copies` are ours, or theirs where we hold
    none. Only slots whose nodes differ are compared by record. Empty tables give an empty result.
    """
    a, b = placed(ours, theirs, most)
    wrong = differing(tree(a), tree(b)).withColumnRenamed("node", "slot")
    columns = ["page_id", *PLACE, "slot", "offset", "length", "leaf", "copies"]
    suspect = lambda df: df.join(wrong, [*PLACE, "slot"], "left_semi")
    # A record's place in its slot: the bytes of the slot before it.
    slot = Window.partitionBy(*PLACE, "slot")
    at = lambda df: suspect(df).withColumn("at", F.col("offset") - F.min("offset").over(slot))
    x, y = at(a).alias("x"), at(b).alias("y")
    same = F.lit(True)
    for c in (*PLACE, "slot", "page_id", "leaf"):
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    met = x.join(y, same, "full_outer")
    held = F.when(F.col("y.slot").isNull(), "ours").when(F.col("x.slot").isNull(), "theirs").otherwise("both")
    ok = (held == "both") & (F.col("x.at") == F.col("y.at")) & (F.col("x.copies") == F.col("y.copies"))
    checked = met.select(*(F.when(F.col("x.slot").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c) for c in columns), held.alias("held"), F.coalesce(ok, F.lit(False)).alias("ok"))
    sound = a.join(wrong, [*PLACE, "slot"], "left_anti").select(*columns, F.lit("both").alias("held"), F.lit(True).alias("ok"))
    return sound.unionByName(checked)


@dataclass
class Record:
    offset: int
    length: int
    header: dict[str, str]
    body: bytes
    error: str | None = None


#: Bytes that enter at once; decompressed bytes of a member that wait for its checksum; the longest header; the longest
#: record body that is read; bytes kept of what is no record.
STEP, MOST_HELD, MOST_HEADER, MOST_BODY, MOST_JUNK = 1 << 18, 64 << 20, 1 << 20, 256 << 20, 1 << 20


def _members(data: bytes) -> Iterator[bytes | Record]:
    """The content of the members of a gzip file in pieces, and a row without an offset for each that is damaged; after it, from the next member on.

    A member's content is given when its checksum has been seen, or piece by piece from `MOST_HELD` bytes on.
    """
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, held, n, pos, pending = zlib.decompressobj(31), [], 0, at, b""
        error = None
        while not unpack.eof:
            if not pending:
                if pos >= len(data):
                    error = "a gzip member ends early"
                    break
                pending = view[pos : pos + STEP]
                pos += len(pending)
            try:
                piece = unpack.decompress(pending, STEP)
            except zlib.error as why:
                error = f"a damaged gzip member: {why}"
                break
            pending = unpack.unconsumed_tail
            n += len(piece)
            held.append(piece)
            if n > MOST_HELD:
                yield from held
                held = []
        if error is None:
            yield from held
            at = pos - len(unpack.unused_data)
            continue
        content = b"" if error.startswith("a damaged") else b"".join(held)
        yield Record(0, len(content), {}, content, error)
        later = data.find(b"\x1f\x8b\x08", at + 1)
        at = len(data) if later < 0 else later


class _Pieces:
    """Bytes that come in pieces up to the end or a damaged member; `held` are those that aren't read yet, from `at` on."""

    def __init__(self, source: Iterator[bytes | Record], at: int):
        self.source, self.at, self.held = source, at, bytearray()
        self.damage: Record | None = None
        self.ended = False

    def more(self) -> bool:
        piece = None if self.damage or self.ended else next(self.source, None)
        if piece is None:
            self.ended = self.ended or self.damage is None
        elif isinstance(piece, Record):
            self.damage = piece
        else:
            self.held += piece
            return True
        return False

    def has(self, n: int) -> bool:
        while len(self.held) < n:
            if not self.more():
                return False
        return True

    def find(self, mark: bytes, start: int, most: int) -> int:
        """Where a mark stands in the next `most` bytes, -1 if nowhere."""
        while True:
            found = self.held.find(mark, start, most)
            if found >= 0:
                return found
            if len(self.held) >= most or not self.more():
                return -1
            start = max(start, len(self.held) - STEP - len(mark) - 1)

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n

    def skip(self, start: int) -> tuple[int, int, bytes]:
        """Drops `start` bytes and all up to the next line that begins a record: from where, how many, and the first of them behind `start`."""
        begun, kept, searched = self.at, bytearray(), max(start - 1, 0)
        skip = start
        while True:
            found = self.held.find(b"\nWARC/", searched)
            if found < 0 and not self.more():
                cut = len(self.held)
            elif found >= 0:
                cut = found + 1
            else:  # the end of what is held may be the mark's beginning
                cut = max(0, len(self.held) - STEP - 5)
                kept += self.held[skip:cut][: MOST_JUNK - len(kept)]
                skip, searched = max(0, skip - cut), max(0, searched - cut)
                self.drop(cut)
                continue
            kept += self.held[skip:cut][: MOST_JUNK - len(kept)]
            self.drop(cut)
            return begun, self.at - begun, bytes(kept)


def parse(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, plain or compressed by record or as a whole; what is no whole record has an `error`.

    Offsets and lengths are those of the uncompressed bytes that can be read. Bytes between records, a record that ends
    early or whose length runs over others, one without a length or longer than `MOST_BODY`, and a damaged gzip member
    each give a row of their own; reading goes on at the next line that begins a record, or the next member. A body with
    an error has `MOST_JUNK` bytes at most. Time is linear, and what is held is bounded by these limits.
    """
    view = memoryview(data)
    source = _members(data) if data[:2] == b"\x1f\x8b" else (bytes(view[i : i + STEP]) for i in range(0, len(data), STEP))
    at = 0
    while True:
        pieces = _Pieces(source, at)
        yield from _records(pieces)
        if pieces.damage is None:
            return
        yield Record(pieces.at, pieces.damage.length, {}, pieces.damage.body, pieces.damage.error)
        at = pieces.at + pieces.damage.length


def _records(pieces: _Pieces) -> Iterator[Record]:
    while pieces.has(5) or pieces.held:
        if not pieces.held.startswith(b"WARC/"):
            at, n, junk = pieces.skip(0)
            if n > MOST_JUNK or junk.strip(b"\r\n"):
                yield Record(at, n, {}, junk, "no record")
            continue
        stop = pieces.find(b"\r\n\r\n", 0, MOST_HEADER)
        if stop < 0:
            at, n, _ = pieces.skip(1)
            yield Record(at, n, {}, b"", "a header ends early")
            continue
        lines = pieces.held[:stop].decode("utf-8", "replace").split("\r\n")
        header = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = next((v for k, v in header.items() if k.lower() == "content-length"), "")
        body, wrong = stop + 4, None
        if not (size.isascii() and size.isdigit()):
            wrong = "no length"
        elif int(size) > MOST_BODY:
            wrong = "a record too long to be read"
        elif not pieces.has(end := body + int(size)):
            wrong = "a record ends early"
        else:
            pieces.has(end + 4)
            closed = pieces.held.startswith(b"\r\n\r\n", end)
            if not closed and pieces.held.find(b"\r\n\r\nWARC/", body, end + 4) >= 0:
                wrong = "a length that runs over other records"
        if wrong:
            at, n, content = pieces.skip(body)
            yield Record(at, n, header, content, wrong)
            continue
        past = end + 4 if closed else end
        yield Record(pieces.at, past, header, bytes(pieces.held[body:end]))
        pieces.drop(past)


#: A row holds a file, so larger ones can't be read; they get a row that says so.
MOST_BYTES = 2_000_000_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: path, offset, length, type, record_id, url, body, error (see `parse`).

    A file of more than `MOST_BYTES` gives one row with an error; WARC files are cut at about a gigabyte by convention.
    """
    names = ["path", "offset", "length", "type", "record_id", "url", "body", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        table = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for i in range(batch.num_rows):
                p, rows, held = batch.column("path")[i].as_py(), [], 0
                for r in parse(batch.column("content")[i].as_py()):
                    rows.append((p, r.offset, r.length, r.header.get("WARC-Type"), r.header.get("WARC-Record-ID"), r.header.get("WARC-Target-URI"), r.body, r.error))
                    held += len(r.body)
                    if held > 32 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    found = spark.read.format("binaryFile").load(path)
    small = found.filter(F.col("length") <= MOST_BYTES).select("path", "content").mapInArrow(run, "path string, offset long, length long, type string, record_id string, url string, body binary, error string")
    large = found.filter(F.col("length") > MOST_BYTES).select("path", F.lit(0).cast("long").alias("offset"), "length", *(F.lit(None).cast(k).alias(c) for c, k in (("type", "string"), ("record_id", "string"), ("url", "string"), ("body", "binary"))), F.lit("a file too large for a row").alias("error"))
    return small.unionByName(large)


def damaged(pages: DataFrame, every: int = 97) -> DataFrame:
    """A replica of `pages` for drills: one page in `every` has its first character overwritten."""
    hit = F.pmod("page_id", F.lit(every)) == 13
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("\x01"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))


def audited(pages: DataFrame) -> DataFrame:
    """The query's rows: an audit of all pages against a damaged replica."""
    return audit(fixity(pages), fixity(damaged(pages))).withColumnRenamed("leaf", "record_sha256")


ORACLE_SQL = r"""
WITH v AS (
  SELECT page_id, url, html, 'ours' AS side FROM pages
  UNION ALL SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN chr(1) || substr(html, 2) ELSE html END, 'theirs' FROM pages
), r AS (
  SELECT page_id, side, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM v
), h AS (
  SELECT page_id, side, page_id // 512 AS archive, CAST(page_id % 512 AS INTEGER) AS slot, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS record_sha256 FROM r
), o AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY side, archive ORDER BY slot, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM h
), a AS (SELECT * FROM o WHERE side = 'ours'), b AS (SELECT * FROM o WHERE side = 'theirs')
SELECT a.page_id, a.archive, 0 AS part, a.slot, a."offset", a.length, a.record_sha256, CAST(1 AS BIGINT) AS copies,
  CASE WHEN b.page_id IS NULL THEN 'ours' ELSE 'both' END AS held, b.page_id IS NOT NULL AS ok
FROM a LEFT JOIN b ON b.page_id = a.page_id AND b.record_sha256 = a.record_sha256
UNION ALL
SELECT b.page_id, b.archive, 0, b.slot, b."offset", b.length, b.record_sha256, CAST(1 AS BIGINT), 'theirs', false
FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = b.page_id AND a.record_sha256 = b.record_sha256)
"""

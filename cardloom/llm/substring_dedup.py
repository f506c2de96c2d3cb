"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one document. Its minimiser is the word `k`-gram of least rank in it.
Consecutive windows that share a minimiser are a super-k-mer and travel as one packed string of their words to the
minimiser's bucket, where equal windows must meet; there they are sorted and their words compared.

1. *Ranks*: a first pass counts super-k-mers by minimiser. Minimisers above `hot` of them rank behind all others, so
   that only windows made of nothing but frequent k-grams share them. Those windows go by a second minimiser of `LONG`
   words, so that text made of frequent k-grams doesn't meet in one bucket. The hot list is bounded by its threshold
   (`HOT_MOST` entries) and broadcast.
2. *Map*: inside a batch of documents, sorted by id, a window that repeats an earlier one of the batch (words
   compared) is settled at once. The rest travels, packed by bucket and compressed.
3. *Buckets*: each bucket sorts its windows by hash, document and start, compares the words of equal hashes, and
   settles every window but the first. A bucket larger than `CHUNK` bytes passes in chunks, of which only the windows
   that are still first stay in memory, so copies of one passage cost no more than one.
4. *Documents*: settled windows come back as word ranges of a document, which loses the words they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cardloom.llm.arrays import RangeHash, Words, mix, normal, spans
from cardloom.llm.shared import discard, staged, sub_batches, texts

WINDOW, K, LONG = 20, 2, 8
#: Super-k-mers of one minimiser above which it is hot, and the most minimisers that can be hot.
HOT_LEAST, HOT_MOST = 2_000, 500_000
#: Super-k-mers to a bucket and buckets to a task, on average, and packed bytes of a bucket that are in memory at once.
BUCKET, BUCKETS, CHUNK = 50_000, 8, 16 << 20
_PACK = 4 << 20
_U = np.uint64
_NULL = np.iinfo(np.int64).min


def leftmost_least(rank: np.ndarray, width: int) -> np.ndarray:
    """Of every `width` values that stand together, the place of the least, the leftmost of equals: it depends on these values alone."""
    at, have = np.arange(len(rank)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at, have = np.where(rank[b] < rank[a], b, a), have + step
    return at


class Batch:
    """The windows of a batch of documents in order of (id, text digest), and each window's minimiser."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, raw: list[bytes], window: int, k: int, hot: np.ndarray):
        order = np.lexsort((marks, ids))
        self.ids, self.marks = ids[order], marks[order]
        self.words = w = Words([normal(raw[i]) for i in order])
        n = len(w.starts)
        self.length = window
        self.at = np.empty(0, np.int64)
        if n < window:
            return
        self.word_hash = RangeHash(w.codes())
        #: First words of windows.
        self.at = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
        first = np.arange(n - k + 1)
        gram = self.word_hash(first, first + k)
        rank = mix(gram ^ _U(0x5851F42D4C957F2D)) >> _U(1)
        frequent = np.zeros(len(gram), bool)
        if len(hot):
            frequent = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
            rank |= frequent.astype(_U) << _U(63)
        place = leftmost_least(rank, window - k + 1)[self.at]
        minimiser = gram[place]
        if frequent.any() and window > LONG > k:
            rows = np.flatnonzero(frequent[place])
            if len(rows):
                start = np.arange(n - LONG + 1)
                long = self.word_hash(start, start + LONG)
                second = leftmost_least(mix(long ^ _U(0x2545F4914F6CDD1D)), window - LONG + 1)[self.at[rows]]
                # Below zero, so that no place of one kind follows from one of the other.
                place[rows], minimiser[rows] = -1 - second, mix(long[second])
        self.place, self.minimiser = place, minimiser

    def runs(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the kept windows, the runs that follow one another and share a minimiser's place: index of the first window, number."""
        at = np.flatnonzero(keep)
        if not len(at):
            return at, at
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(self.at[at]) != 1) | (np.diff(self.place[at]) != 0)
        head = np.flatnonzero(new)
        return at[head], np.diff(np.append(head, len(at)))


def _same(data: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, lead: np.ndarray, length: int, broken: np.ndarray) -> np.ndarray:
    """Whether windows that begin with the words `at` and `lead` (None after a break) are equal, comparing whole stretches where both advance together."""
    ok = np.ones(len(at), bool)
    if not len(at):
        return ok
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(lead) != 1) | broken[1:]
    head = np.flatnonzero(new)
    for h, n in zip(head.tolist(), np.diff(np.append(head, len(at))).tolist(), strict=True):
        a, b = int(at[h]), int(lead[h])
        if data[starts[a] : ends[a + n + length - 2]] != data[starts[b] : ends[b + n + length - 2]]:
            for i in range(n):
                ok[h + i] = data[starts[a + i] : ends[a + i + length - 1]] == data[starts[b + i] : ends[b + i + length - 1]]
    return ok


def _repeats(code: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that repeat an earlier position of `order` with the same code, and that first one."""
    c = code[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order[~new], lead[~new]


def local_repeats(b: Batch) -> np.ndarray:
    """Of a batch's windows, whether an equal one comes earlier in the batch."""
    out = np.zeros(len(b.at), bool)
    if len(b.at):
        code, owner = b.word_hash(b.at, b.at + b.length), b.words.doc[b.at]
        # Windows are in order of document and start unless rows repeat an id; then starts decide.
        plain = not (np.diff(b.ids) == 0).any()
        order = np.argsort(code, kind="stable") if plain else np.lexsort((b.at - b.words.first[owner], b.ids[owner], code))
        again, lead = _repeats(code, order)
        o = np.argsort(again)
        again, lead = again[o], lead[o]
        # Rows that repeat an id and a text are one document: of theirs, neither window is earlier.
        doc, lead_doc = b.words.doc[b.at[again]], b.words.doc[b.at[lead]]
        start, lead_start = b.at[again] - b.words.first[doc], b.at[lead] - b.words.first[lead_doc]
        twin = (b.ids[doc] == b.ids[lead_doc]) & (start == lead_start)
        same = _same(b.words.data, b.words.starts, b.words.ends, b.at[again], b.at[lead], b.length, np.zeros(len(again), bool))
        out[again[same & ~twin]] = True
    return out


def _pack(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    raw = len(arrays[0]).to_bytes(4, "little") + b"".join(a.tobytes() for a in arrays) + text
    return b"\1" + zstandard.ZstdCompressor(level=3).compress(raw) if len(raw) > 512 else b"\0" + raw


def _unpack(blob: bytes, kinds: tuple) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[0] else blob[1:]
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, raw[at:]


# Columns of a packed super-k-mer: id, text digest, first word, windows, bytes of its words.
_SUPER = (np.int64, np.int64, np.int32, np.int32, np.int32)
# Columns of a settled range: id, text digest, first word, word after the last.
_RANGE = (np.int64, np.int64, np.int32, np.int32)


def ranges_of(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Windows sorted by document and start as ranges of words, overlapping ones in one."""
    if not len(ids):
        return [np.empty(0, k) for k in _RANGE]
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(marks) != 0) | (np.diff(start) > length) | (np.diff(start) < 0)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(ids)) - 1
    return [ids[head].astype(np.int64), marks[head].astype(np.int64), start[head].astype(np.int32), (start[last] + length).astype(np.int32)]


def superkmers(b: Batch, repeat: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed super-k-mers) of the windows that are not settled; (-1, packed ranges) of those that are."""
    w = b.words
    if repeat.any():
        at = b.at[repeat]
        doc = w.doc[at]
        yield -1, _pack(*ranges_of(b.ids[doc], b.marks[doc], at - w.first[doc], b.length))
    head, count = b.runs(~repeat)
    if not len(head):
        return
    gram, at = b.minimiser[head], b.at[head]
    bucket = (mix(gram) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    count, at, bucket = count[order], at[order], bucket[order]
    doc = w.doc[at]
    low, high = w.starts[at], w.ends[at + count + b.length - 2]
    columns = b.ids[doc], b.marks[doc], (at - w.first[doc]).astype(np.int32), count.astype(np.int32), (high - low).astype(np.int32)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
        text = b" ".join(map(w.data.__getitem__, map(slice, low[s:e].tolist(), high[s:e].tolist())))
        yield int(bucket[s]), _pack(*(c[s:e] for c in columns), text=text)


def bucket_repeats(blobs: list[bytes], length: int, rest: bool = False) -> tuple[list[np.ndarray], bytes | None]:
    """Ranges of the windows of a bucket that repeat an earlier window; with `rest` also what is left, packed, each window of a document once."""
    parts = [_unpack(x, _SUPER) for x in blobs]
    ids, marks, first, count, size = (np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True))
    data = b" ".join(p[1] for p in parts)
    offset = np.cumsum(size.astype(np.int64) + 1) - size - 1
    pick = np.lexsort((first, marks, ids))
    w = Words([b" ".join(map(data.__getitem__, map(slice, offset[pick].tolist(), (offset[pick] + size[pick]).tolist())))])
    del parts, data
    ids, marks, first, count = ids[pick], marks[pick], first[pick], count[pick].astype(np.int64)
    run = np.repeat(np.arange(len(pick)), count)
    k = spans(count)
    word = np.cumsum(count + length - 1) - (count + length - 1)
    at = word[run] + k
    code = RangeHash(w.codes())(at, at + length)
    start = first[run].astype(np.int64) + k
    # Runs are in order of document and start, and so are the windows unless rows repeat an id; then starts decide.
    order = np.lexsort((start, ids[run], code)) if (np.diff(ids) == 0).any() else np.argsort(code, kind="stable")
    again, lead = _repeats(code, order)
    o = np.argsort(again)
    again, lead = again[o], lead[o]
    broken = np.ones(len(again), bool)
    broken[1:] = (np.diff(run[again]) != 0) | (np.diff(run[lead]) != 0)
    good = _same(w.data, w.starts, w.ends, at[again], at[lead], length, broken)
    twin = (ids[run[again]] == ids[run[lead]]) & (start[again] == start[lead])
    if not good.all():
        # Unequal words of equal hash: settle those hashes by the words themselves.
        clash = np.isin(code, code[again[~good]])
        seen: dict[bytes, int] = {}
        extra = []
        for i in order[clash[order]].tolist():
            text = w.data[w.starts[at[i]] : w.ends[at[i] + length - 1]]
            j = seen.setdefault(text, i)
            if j != i and (ids[run[j]], start[j]) != (ids[run[i]], start[i]):
                extra.append(i)
        again = np.concatenate([again[good & ~twin & ~clash[again]], np.array(extra, np.int64)]).astype(np.int64)
        again.sort()
    else:
        again = again[~twin]
    s = np.lexsort((start[again], marks[run[again]], ids[run[again]]))
    again = again[s]
    settled = ranges_of(ids[run[again]], marks[run[again]], start[again], length)
    if not rest:
        return settled, None
    keep = np.ones(len(at), bool)
    keep[again] = False
    # Rows that repeat an id and a text bring the same windows: one of each is enough.
    left = np.flatnonzero(keep)
    left = left[np.lexsort((start[left], marks[run[left]], ids[run[left]]))]
    same = np.zeros(len(left), bool)
    same[1:] = (np.diff(ids[run[left]]) == 0) & (np.diff(marks[run[left]]) == 0) & (np.diff(start[left]) == 0)
    left = np.sort(left[~same])
    new = np.ones(len(left), bool)
    new[1:] = (np.diff(left) != 1) | (np.diff(run[left]) != 0)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(left)))
    h = left[head]
    low, high = w.starts[at[h]], w.ends[at[h] + n + length - 2] if len(h) else np.empty(0, np.int64)
    columns = ids[run[h]], marks[run[h]], start[h].astype(np.int32), n.astype(np.int32), (high - low).astype(np.int32)
    return settled, _pack(*columns, text=b" ".join(map(w.data.__getitem__, map(slice, low.tolist(), high.tolist()))))


def _batches(batches: Iterator[pa.RecordBatch], window: int, k: int, hot: np.ndarray) -> Iterator[Batch]:
    for part in sub_batches(batches, "text", _PACK):
        ids = part.column("doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False)
        yield Batch(ids, part.column("mark").to_numpy(zero_copy_only=False), texts(part, "text"), window, k, hot)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, bucket: int = BUCKET, hot_least: int = HOT_LEAST, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, mark, ranges): of each document with repeated windows the word ranges that they cover; `mark` is a hash of its text, which keeps rows apart that repeat an id."""
    spark, keyed = docs.sparkSession, _keyed(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, window, k, np.empty(0, _U)):
            if len(b.at):
                head, _ = b.runs(np.ones(len(b.at), bool))
                gram, n = np.unique(b.minimiser[head], return_counts=True)
                yield pa.record_batch({"gram": pa.array(gram.view(np.int64)), "n": pa.array(n.astype(np.int32))})

    seen = Observation()
    counts = keyed.mapInArrow(count, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = staged(counts.observe(seen, F.sum("n").alias("total")).filter(F.col("n") >= hot_least))
    total = seen.get["total"] or 0
    # At most HOT_MOST minimisers can have so large a share of the total.
    least = max(hot_least, total // HOT_MOST)
    hot = np.sort(np.array([r[0] for r in frequent.filter(F.col("n") >= least).select("gram").collect()], np.int64).view(_U))
    discard(frequent)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // bucket)
    # Tasks follow from the number of super-k-mers, so what one of them reads doesn't grow with the input.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS)
    shared_hot = spark.sparkContext.broadcast(hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(_batches(batches, window, k, shared_hot.value)):
            if len(b.at):
                out = list(superkmers(b, local_repeats(b), buckets))
                # Settled ranges have no bucket of their own: any will do.
                keys = [x if x >= 0 else int(mix(np.array([b.ids[0] + i], np.int64).view(_U))[0] % _U(buckets)) for x, _ in out]
                yield pa.record_batch({"bucket": pa.array(keys, pa.int64()), "settled": pa.array([x < 0 for x, _ in out]), "blob": pa.array([y for _, y in out], pa.binary())})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(columns: list[np.ndarray]) -> pa.RecordBatch:
            ids = pa.array(columns[0], mask=columns[0] == _NULL)
            return pa.record_batch([ids, *map(pa.array, columns[1:])], ["doc_id", "mark", "first", "past"])

        now, blobs, held, limit = None, [], 0, chunk
        for batch in batches:
            for key, settled, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "settled", "blob")), strict=True):
                if key != now:
                    if blobs:
                        yield table(bucket_repeats(blobs, window)[0])
                    now, blobs, held, limit = key, [], 0, chunk
                if settled:
                    yield table(_unpack(blob, _RANGE)[0])
                    continue
                blobs.append(blob)
                held += len(blob)
                if held > limit:
                    ranges, left = bucket_repeats(blobs, window, rest=True)
                    yield table(ranges)
                    blobs, held = [left], len(left)
                    limit = max(chunk, 2 * held)
        if blobs:
            yield table(bucket_repeats(blobs, window)[0])

    settled = keyed.mapInArrow(send, "bucket long, settled boolean, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, "doc_id long, mark long, first int, past int")
    return settled.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "past")).alias("ranges"))


def cut(text: bytes, first: list[int], past: list[int]) -> tuple[int, int, bytes]:
    """Words, words removed and what is left, words joined by one space, after the ranges' words are gone."""
    words = text.split()
    if not first:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, past, -1)
    keep = np.cumsum(edge)[:-1] <= 0
    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _applied(docs: DataFrame, id_col: str, text_col: str, extra: list[str], schema: str, make: Callable, **options) -> DataFrame:
    """Joins documents with their ranges and maps every row; texts travel compressed, `extra` columns as a struct."""
    ranges = repeated_ranges(docs, id_col=id_col, text_col=text_col, **options)
    rest = F.struct(*(F.col(f"`{c}`") for c in extra)) if extra else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), rest.alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in sub_batches(batches, "text", _PACK):
            z = [None if t is None else pack(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("mark"), pa.array(z, pa.binary()), b.column("rest")], ["doc_id", "mark", "z", "rest"])

    keyed = rows.mapInArrow(squeeze, f"doc_id long, mark long, z binary, rest {kind}")
    right = ranges.select(F.col("doc_id").alias("r_id"), F.col("mark").alias("r_mark"), F.col("ranges.first").alias("first"), F.col("ranges.past").alias("past"))
    joined = keyed.join(right, keyed["doc_id"].eqNullSafe(right["r_id"]) & (keyed["mark"] == right["r_mark"]), "left").drop("r_id", "r_mark", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in sub_batches(batches, "z", _PACK // 2):
            raw = [None if z is None else unpack(z) for z in b.column("z").to_pylist()]
            cuts = [cut(t or b"", f or [], p or []) for t, f, p in zip(raw, b.column("first").to_pylist(), b.column("past").to_pylist(), strict=True)]
            yield make(b, raw, cuts)

    return joined.mapInArrow(run, schema)


def dedup_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per input row.

    A window goes if the same words also start earlier: in a document of smaller id, or earlier in the same one. A null
    id counts as smaller than any other. Of rows that repeat an id, neither is earlier than the other at the same start;
    if the texts are equal too, they are one document and share the result. Null, empty and short texts keep all words.
    Windows at the same start of rows with one id (null ids too) all stay in their bucket's memory, for none is earlier.
    """

    def make(b: pa.RecordBatch, raw: list, cuts: list) -> pa.RecordBatch:
        sha = [hashlib.sha256(c[2]).hexdigest() for c in cuts]
        return pa.record_batch([b.column("doc_id"), pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _applied(docs, id_col, text_col, [], "doc_id long, n_words long, n_removed long, kept_sha256 string", make, **options)


def dedup_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with a column `kept_text` (words joined by one space; null for a null text) and a long `n_removed`; other columns as they were.

    A text that loses no word stays as it was, white space included.
    """
    extra = [c for c in docs.columns if c != text_col]

    def make(b: pa.RecordBatch, raw: list, cuts: list) -> pa.RecordBatch:
        text = [None if t is None else t.decode() for t in raw]
        kept = [t if not c[1] else c[2].decode() for t, c in zip(text, cuts, strict=True)]
        return pa.record_batch([b.column("rest"), pa.array(text, pa.string()), pa.array(kept, pa.string()), pa.array([c[1] for c in cuts], pa.int64())], ["rest", "text", "kept_text", "n_removed"])

    kind = docs.select(F.struct(*(F.col(f"`{c}`") for c in extra)).alias("rest")).schema["rest"].dataType.simpleString()
    out = _applied(docs, id_col, text_col, extra, f"rest {kind}, text string, kept_text string, n_removed long", make, **options)
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, "kept_text", "n_removed")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id, p) AS n FROM s),
c AS (SELECT DISTINCT doc_id, p + k AS p FROM r, range(20) AS t(k) WHERE n > 1),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

"""Matroska files: a writer and a parser of EBML elements, clusters, lacing and cues.

The parser yields packet tables: every frame with its track, timestamp, key flag and byte range in the file. A text is
stored as one track of 8-bit mono PCM whose samples are its UTF-8 bytes, padded to a multiple of 64.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import sub_batches, texts

# Element ids of the Matroska specification (RFC 9559) and EBML (RFC 8794).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP = 0xAE, 0xE1, 0xBB, 0xB7, 0xA0
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION = 0x2AD7B1, 0xE7, 0xA3, 0xA1, 0x9B
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, SAMPLING, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0x4282, 0x4287, 0x4285, 0xB3, 0xF7, 0xF1
MUXER, WRITER = 0x4D80, 0x5741
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP))
PCM = "A_PCM/INT/LIT"
#: Samples a second, of a frame, frames of a laced block, and blocks of a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 512, 4, 16
UNIT = 64
#: Sampling rates under this are none: a frame would last longer than timestamps can say.
LEAST_RATE = 1e-3


class Malformed(ValueError):
    """A file that isn't well-formed Matroska."""


def size_of(n: int, width: int = 0) -> bytes:
    """`n` as an EBML variable-length size, in the least width or the one given."""
    width = width or next((w for w in range(1, 9) if n < (1 << 7 * w) - 1), 0)
    if not width:
        raise ValueError("too large for a size")
    return (n | 1 << 7 * width).to_bytes(width, "big")


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """The size at `at`, None for an unknown one, and the place after it."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"a size ends early at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def element(ident: int, body: bytes | int | str | float) -> bytes:
    """One element with its id and size."""
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    elif isinstance(body, float):
        body = np.array(body, ">f8").tobytes()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_of(len(body)) + body


@dataclass
class Element:
    ident: int
    start: int  # of the id
    body: int
    end: int


def _header(data: bytes, at: int, end: int) -> tuple[int, int | None, int]:
    """Id and size (None if unknown) of the element at a byte, and where its body begins."""
    if at >= end or not data[at]:
        raise Malformed(f"no id at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise Malformed(f"no id at byte {at}")
    size, body = read_size(data, at + width)
    return int.from_bytes(data[at : at + width], "big"), size, body


def elements(data: bytes, at: int, end: int) -> Iterator[Element]:
    """The elements one after the other in data[at:end]. One of unknown size runs to the next of its own level or the end."""
    while at < end:
        start = at
        ident, size, body = _header(data, at, end)
        if size is None:
            stop = end
            if ident == CLUSTER:
                stop = body
                while stop < end:
                    child, length, inside = _header(data, stop, end)
                    if child in (CLUSTER, CUES, TRACKS, INFO):
                        break
                    if length is None:
                        raise Malformed(f"an element of unknown size in a cluster at byte {stop}")
                    stop = inside + length
            size = stop - body
        if body + size > end:
            raise Malformed(f"an element at byte {start} ends after its parent")
        yield Element(ident, start, body, body + size)
        at = body + size


def uint(data: bytes, e: Element) -> int:
    if e.end - e.body > 8:
        raise Malformed(f"an integer of more than 8 bytes at byte {e.start}")
    return int.from_bytes(data[e.body : e.end], "big")


def real(data: bytes, e: Element) -> float:
    """A float of 0 (zero), 4 or 8 bytes."""
    if e.end - e.body not in (0, 4, 8):
        raise Malformed(f"a float of {e.end - e.body} bytes at byte {e.start}")
    return float(np.frombuffer(data[e.body : e.end], f">f{e.end - e.body}")[0]) if e.end > e.body else 0.0


@dataclass
class Packet:
    track: int
    timestamp: int  # nanoseconds
    key: bool
    start: int
    end: int
    cluster: int


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # nanoseconds, track, first byte of the cluster


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose payload is data[at:end]; kind 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        return [(at, end)]
    if at >= end:
        raise Malformed("a laced block without frames")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise Malformed("fixed lacing doesn't divide its block")
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed("Xiph lacing ends early")
                size, b, at = size + data[at], data[at], at + 1
                if b < 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            before = at
            value, at = read_size(data, at)
            bits = 7 * (at - before)
            value = (1 << bits) - 1 if value is None else value
            sizes.append(value if not i else sizes[-1] + value - ((1 << bits - 1) - 1))
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise Malformed("lacing doesn't fit its block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """All packets, tracks and cues of a file; raises `Malformed` for one that is not well-formed."""
    top = list(elements(data, 0, len(data)))
    if not top or top[0].ident != EBML:
        raise Malformed("no EBML header")
    media, scale = Media(), 1_000_000
    for segment in (e for e in top if e.ident == SEGMENT):
        for e in elements(data, segment.body, segment.end):
            if e.ident == INFO:
                scale = next((uint(data, x) for x in elements(data, e.body, e.end) if x.ident == TIMESTAMP_SCALE), scale)
            elif e.ident == TRACKS:
                for entry in elements(data, e.body, e.end):
                    if entry.ident == TRACK_ENTRY:
                        _track(data, entry, media)
            elif e.ident == CLUSTER:
                _cluster(data, e, scale, media)
            elif e.ident == CUES:
                for point in elements(data, e.body, e.end):
                    if point.ident == CUE_POINT:
                        _cue(data, point, scale, segment.body, media)
    return media


def _track(data: bytes, entry: Element, media: Media) -> None:
    got = {"type": 0, "codec": "", "rate": None, "channels": 1, "bits": None}
    number = 0
    for x in elements(data, entry.body, entry.end):
        if x.ident == TRACK_NUMBER:
            number = uint(data, x)
        elif x.ident == TRACK_TYPE:
            got["type"] = uint(data, x)
        elif x.ident == CODEC_ID:
            got["codec"] = data[x.body : x.end].decode("ascii", "replace")
        elif x.ident == AUDIO:
            for a in elements(data, x.body, x.end):
                if a.ident == SAMPLING:
                    got["rate"] = real(data, a)
                    if not LEAST_RATE <= got["rate"] < np.inf:  # NaN included
                        raise Malformed(f"no sampling rate at byte {a.start}")
                elif a.ident == CHANNELS:
                    got["channels"] = uint(data, a)
                elif a.ident == BIT_DEPTH:
                    got["bits"] = uint(data, a)
    media.tracks[number] = got


def _cue(data: bytes, point: Element, scale: int, base: int, media: Media) -> None:
    time = 0
    for x in elements(data, point.body, point.end):
        if x.ident == CUE_TIME:
            time = uint(data, x) * scale
        elif x.ident == CUE_POSITIONS:
            at = {y.ident: uint(data, y) for y in elements(data, x.body, x.end)}
            media.cues.append((time, at.get(CUE_TRACK, 0), base + at.get(CUE_CLUSTER, 0)))


def _cluster(data: bytes, cluster: Element, scale: int, media: Media) -> None:
    base = 0

    def block(e: Element, duration: int | None = None) -> None:
        track, at = read_size(data, e.body)
        if track is None or at + 3 > e.end:
            raise Malformed(f"a block at byte {e.start} has no header")
        time = base + int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        frames = laced(data, at + 3, e.end, flags >> 1 & 3)
        rate = media.tracks.get(track, {}).get("rate")
        bits = media.tracks.get(track, {}).get("bits") or 8
        ns, passed = time * scale, 0
        for i, (a, b) in enumerate(frames):
            # Frames of a lace follow one another: by the block's duration, else by their samples.
            later = duration * scale * i // len(frames) if duration is not None else round(passed * 1e9 / rate) if rate else 0
            if not -(1 << 63) <= ns + later < 1 << 63:
                raise Malformed(f"a timestamp out of range at byte {e.start}")
            media.packets.append(Packet(track, ns + later, bool(flags & 0x80), a, b, cluster.start))
            passed += (b - a) * 8 // bits

    for e in elements(data, cluster.body, cluster.end):
        if e.ident == TIMESTAMP:
            base = uint(data, e)
        elif e.ident == SIMPLE_BLOCK:
            block(e)
        elif e.ident == BLOCK_GROUP:
            inner = list(elements(data, e.body, e.end))
            lasting = next((uint(data, x) for x in inner if x.ident == BLOCK_DURATION), None)
            for x in inner:
                if x.ident == BLOCK:
                    block(x, lasting)


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames as the payload of a block with lacing of a kind."""
    if kind == 0:
        return b"".join(frames)
    head = bytes([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3 and len(frames) > 1:
        head += size_of(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += size_of(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, *, frame: int = FRAME, group: int = LACED, blocks: int = BLOCKS, lacing: int = 3) -> bytes:
    """A file with one PCM track whose samples are the payload's bytes; cues point at every cluster."""
    samples_to_ms = lambda n: n * 1000 // RATE
    head = element(EBML, element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
    audio = element(AUDIO, element(SAMPLING, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, PCM) + audio)
    body = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, "cardloom") + element(WRITER, "cardloom")) + element(TRACKS, track)
    parts, size, cues = [body], len(body), []
    per_block = frame * group
    for at in range(0, len(payload), per_block * blocks):
        inside, base = [], samples_to_ms(at)
        for b in range(at, min(at + per_block * blocks, len(payload)), per_block):
            piece = payload[b : b + per_block]
            frames = [piece[i : i + frame] for i in range(0, len(piece), frame)]
            kind = lacing if len(frames) > 1 else 0
            inside.append(element(SIMPLE_BLOCK, size_of(1) + (samples_to_ms(b) - base).to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace(frames, kind)))
        cluster = element(CLUSTER, element(TIMESTAMP, base) + b"".join(inside))
        cues.append(element(CUE_POINT, element(CUE_TIME, base) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, size))))
        parts.append(cluster)
        size += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p.start : p.end] for p in media.packets if p.track == track])


def feature_of(payload: bytes, media: Media) -> str:
    """Whole-number features of the samples and packets: mean and deviation in hundredths, range, crossings of the middle, packets, clusters, cues, milliseconds."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, s, q = len(x), int(x.sum()), int((x * x).sum())
    above = x >= 128
    last = max((p.timestamp for p in media.packets), default=0) // 1_000_000
    return f"mean={100 * s // n};dev={int(100 * np.sqrt(max(0, n * q - s * s)) / n)};min={x.min()};max={x.max()};cross={int((above[1:] != above[:-1]).sum())};packets={len(media.packets)};clusters={len({p.cluster for p in media.packets})};cues={len(media.cues)};last_ms={last}"


def stored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every text as a Matroska file; null counts as empty, which is stored as 64 zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text"):
            yield pa.record_batch([b.column("doc_id"), pa.array([write(padded(t)) for t in texts(b, "text")], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, media binary")


def packets(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table of a column of Matroska files: doc_id, packet, track, timestamp_ns, key, first_byte, past_byte, cluster_byte, error.

    A null file gives no row; one that is malformed gives one row with `error` and nulls.
    """
    schema = "doc_id long, packet int, track long, timestamp_ns long, key boolean, first_byte long, past_byte long, cluster_byte long, error string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "media"):
            rows = []
            for ident, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    rows += [(ident, i, p.track, p.timestamp, p.key, p.start, p.end, p.cluster, None) for i, p in enumerate(parse(data).packets)]
                except Malformed as why:
                    rows.append((ident, *[None] * 7, str(why)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def media_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row per input row.

    Texts are stored, parsed again, and described by what was read back. Rows that repeat keep their number; equal
    texts have equal values. Null counts as empty. Columns other than the two named are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def row(text: bytes) -> tuple:
        data = write(padded(text))
        media = parse(data)
        payload = payload_of(data, media)
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in sub_batches(batches, "text"):
            columns = zip(*map(row, texts(b, "text")), strict=True)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

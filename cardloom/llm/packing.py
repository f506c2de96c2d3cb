"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces go longest first into the open bin with the least room that still holds them. If none does, a bin opens; at the
end every bin shrinks to the least permitted size that holds its contents. The sizes are optimised jointly: a shard is
packed once by every opening rule - each permitted size as the least that is opened, and the size that costs least for
a token of what it can still be filled with from the pieces that are left - and the cheapest outcome counts, so no
single size does better. Documents are packed in shards of bounded size that follow from ids, texts and total length
alone, so the result does not depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import staged

SIZES = (512, 1024, 2048, 4096, 8192)
#: Tokens of a shard, on average.
SHARD = 1 << 17


def sequence_cost(size: int) -> float:
    """The cost of a sequence: a fixed part, its tokens, and attention that grows with the square."""
    return 64 + size + size * size / 16384


def words(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _pack_by(lengths: list[int], sizes: tuple[int, ...], opens: Callable[[int, int], int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit of lengths in falling order; `opens` names the size to open for a length and the tokens left after it that no open bin has room for."""
    by_room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    room_mask = 0  # bit r is set if a bin has room r
    used: list[int] = []
    placed: list[tuple[int, int]] = []
    capacity: list[int] = []
    left, room_open = sum(lengths), 0
    for n in lengths:
        fits = room_mask >> n
        left -= n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                room_mask ^= 1 << room
            room_open -= n
        else:
            at = len(used)
            used.append(0)
            capacity.append(opens(n, max(0, left - room_open)))
            room_open += capacity[at] - n
        placed.append((at, used[at]))
        used[at] += n
        spare = capacity[at] - used[at]
        if spare:
            by_room[spare].append(at)
            room_mask |= 1 << spare
    return placed, [next(s for s in sizes if s >= u) for u in used]


def pack(lengths: Iterable[int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[tuple[int, int]], list[int]]:
    """For lengths in falling order each one's (bin, offset), and the sizes of all bins: of all opening rules the outcome of least cost, the first of equals."""
    sizes, lengths = tuple(sorted(sizes)), list(lengths)

    def by_filling(n: int, rest: int) -> int:
        return min((s for s in sizes if s >= n), key=lambda s: (cost(s) / min(s, n + rest), s))

    def at_least(low: int) -> Callable[[int, int], int]:
        return lambda n, rest: next(s for s in sizes if s >= max(n, low))

    best = None
    for rule in (by_filling, *map(at_least, sizes)):
        placed, found = _pack_by(lengths, sizes, rule)
        total = sum(map(cost, found))
        if best is None or total < best[0]:
            best = total, placed, found
    return best[1], best[2]


def packed(docs: DataFrame, *, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = sequence_cost, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, first, length, shard, bin, bin_size, offset): where every piece of every document goes.

    `length` is a document's length in tokens (words by default). One longer than the largest size is cut into pieces
    of that size and a rest; piece p begins at token `first`. A document without tokens has one row with nulls for
    the bin. Rows that repeat an id are packed singly. Equal lengths go in order of id and piece. Null ids are packed too.
    A shard that repeated rows make longer than eight times the average is packed in parts, so none is held whole.
    """
    largest = max(sizes)
    n = F.coalesce(words(F.col(text_col)) if length is None else length, F.lit(0)).cast("long")
    # Rows are dealt by id and text, so neither null ids nor copies of one text meet in one shard.
    lengths = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), F.xxhash64(id_col, *([text_col] if text_col in docs.columns else [])).alias("spread")))
    total = lengths.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard))
    pieces = (
        lengths.filter("n > 0")
        .select("doc_id", "n", "spread", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(largest).cast("long"))).alias("piece", "first"))
        .select("doc_id", "piece", "first", F.least(F.col("n") - F.col("first"), F.lit(largest)).cast("int").alias("length"), F.pmod(F.xxhash64("spread", "piece"), F.lit(shards)).alias("shard"))
    )
    names = ["doc_id", "piece", "first", "length", "shard", "bin", "bin_size", "offset"]
    schema = "doc_id long, piece int, first long, length int, shard long, bin int, bin_size int, offset int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bins = tokens = 0  # of the shard's parts so far, and of the part at hand

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            placed, size = pack(t.column("length").to_pylist(), sizes, cost)
            more = [[bins + b for b, _ in placed], [size[b] for b, _ in placed], [o for _, o in placed]]
            return pa.Table.from_arrays([*t.columns, *(pa.array(m, pa.int32()) for m in more)], names).combine_chunks().to_batches()[0]

        for batch in batches:
            column = batch.column("shard")
            at = 0
            while at < batch.num_rows:
                key = column[at].as_py()
                end = at
                low, high = at, batch.num_rows  # shards stand together and in order
                while low < high:
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if column[mid].as_py() <= key else (low, mid)
                end = low
                if held and held[0].column("shard")[0].as_py() != key:
                    yield done()
                    bins, held, tokens = 0, [], 0
                # A part ends where the tokens of its pieces would pass the limit, wherever batches end.
                sums = tokens + np.cumsum(batch.column("length").slice(at, end - at).to_numpy().astype(np.int64))
                fit = int(np.searchsorted(sums, 8 * shard, "right"))
                if not fit and held:
                    out = done()
                    yield out
                    bins, held, tokens = bins + len(set(out.column("bin").to_pylist())), [], 0
                    continue
                fit = max(1, fit)
                held.append(batch.slice(at, fit))
                tokens = int(sums[fit - 1])
                at += fit
        if held:
            yield done()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = pieces.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece").mapInArrow(run, schema)
    empty = lengths.filter("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("length"), *(F.lit(None).cast(k).alias(c) for c, k in (("shard", "long"), ("bin", "int"), ("bin_size", "int"), ("offset", "int"))))
    return full.union(empty)

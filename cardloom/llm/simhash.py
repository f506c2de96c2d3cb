"""Near-duplicates by 64-bit SimHash and BK-trees.

Fingerprints that differ in at most 3 bits agree in all bits of at least `blocks - 3` of `blocks` blocks. So each
distinct fingerprint goes to one shard for every such choice of blocks, and a BK-tree over the shard (children keyed
by their Hamming distance to the parent) answers radius searches by following only edges within the radius. A shard
with more than `shard_cap` fingerprints is sharded again by blocks of its other bits, of which one must agree as well;
what is still larger is cut into parts, and every part's tree is sent to every part's searches.
A search leaves only the links that join two groups, so a shard emits fewer links than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.arrays import Words, normal
from cardloom.llm.components import components
from cardloom.llm.shared import looked_up, staged, sub_batches, texts

SEED, RADIUS, SHINGLE = 42, 3, 3
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def fingerprints_of(batch: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of every text: A-Z lower-cased, XXH64 (seed 42) of its word shingles, repeats included."""
    words = Words([normal(t.lower()) for t in batch])
    n = np.diff(words.first)
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(n.dtype))
    total = int(count.sum())
    out = np.zeros(len(batch), np.uint64)
    if not total:
        return out
    doc = np.repeat(np.arange(len(batch)), count)
    before = np.cumsum(count) - count
    k = np.arange(total) - before[doc]
    first = words.first[:-1][doc] + k
    last = np.minimum(first + shingle, words.first[1:][doc]) - 1
    pieces = map(words.data.__getitem__, map(slice, words.starts[first].tolist(), words.ends[last].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, total)
    # Eight counters to a word, summed over at most 255 shingles at a time.
    cut = np.flatnonzero(k % 255 == 0)
    owner = doc[cut]
    starts = np.searchsorted(owner, np.flatnonzero(count))
    planes = h.view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(count)
    for p in range(8):
        part = np.add.reduceat(_LANES[planes[:, p]], cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(part, starts, axis=0)
        bits = (2 * ones > count[full][:, None]).astype(np.uint64)
        out[full] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * p)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per input row, fp a signed 64-bit fingerprint; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text", 2 << 20):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fingerprints_of(texts(b, "text"), shingle).view(np.int64))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Fingerprints as nodes; a child hangs on its parent by their Hamming distance."""

    def __init__(self) -> None:
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, fp: int) -> int:
        """Hangs `fp` into the tree and returns its node; an equal fingerprint shares the node."""
        fps, children = self.fps, self.children
        if not fps:
            fps.append(fp)
            children.append({})
            return 0
        at = 0
        while d := (fps[at] ^ fp).bit_count():
            nxt = children[at].get(d)
            if nxt is None:
                children[at][d] = new = len(fps)
                fps.append(fp)
                children.append({})
                return new
            at = nxt
        return at

    def within(self, fp: int, radius: int) -> list[int]:
        """Nodes at most `radius` bits away."""
        fps, children, found = self.fps, self.children, []
        todo = [0] if fps else []
        while todo:
            at = todo.pop()
            d = (fps[at] ^ fp).bit_count()
            if d <= radius:
                found.append(at)
            if edges := children[at]:
                low, high = d - radius, d + radius
                todo += [c for e, c in edges.items() if low <= e <= high]
        return found


def joining(tree_side: list[tuple[int, int]], search_side: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """Links (id, id) that connect what lies within the radius, without those that close a cycle.

    `tree_side` is hung into a BK-tree; `search_side` searches it, or, if None, each fingerprint searches before it is hung.
    """
    tree, owner, parent, out = BKTree(), [], {}, []

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def link(node: int, fp: int) -> None:
        for hit in tree.within(fp, radius):
            a, b = root(owner[hit]), root(node)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((owner[hit], node))

    for fp, node in tree_side:
        if search_side is None:
            link(node, fp)
        if tree.add(fp) == len(owner):
            owner.append(node)
    for fp, node in search_side or ():
        link(node, fp)
    return out


def _blocks(blocks: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def _masks(blocks: int, radius: int) -> list[int]:
    """Of every choice of blocks - radius blocks their bits."""
    return [sum(((1 << (b - a)) - 1) << a for a, b in chosen) for chosen in combinations(_blocks(blocks), blocks - radius)]


def _finer_masks(mask: int, radius: int) -> list[int]:
    """The mask with each of radius + 1 parts of the bits outside it: two fingerprints within the radius that agree in the mask agree in one of these."""
    rest = [i for i in range(64) if not mask >> i & 1]
    edges = [round(len(rest) * i / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << i for i in rest[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def links(fps: DataFrame, *, radius: int = RADIUS, shard_cap: int = 4096, blocks: int | None = None) -> DataFrame:
    """(a, b): ids of `fps` (id, fp), one id a fingerprint, whose components are those of all links within the radius.

    With `blocks` None it follows from the number of fingerprints: wider keys for more, so that shards stay small.
    """
    if blocks is None:
        n = fps.count()
        blocks = radius + 1 if n <= 1 << 22 else radius + 2 if n <= 1 << 31 else radius + 3
    masks, fp = _masks(blocks, radius), F.col("fp")
    keys = F.array(*(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)))
    keyed = fps.select("id", "fp", F.explode(keys).alias("key")).select("id", "fp", "key.k", "key.bits")
    count = lambda df: df.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = keyed.join(count(keyed), ["k", "bits"])
    large = staged(count(keyed).filter(F.col("n") > shard_cap).select("k", "bits"))
    if large.limit(1).count():
        finer = F.array(*(F.array(*(F.lit(_signed(m)) for m in _finer_masks(mask, radius))) for mask in masks))[F.col("k")]
        again = F.transform(finer, lambda m, j: F.struct((F.lit(len(masks)) + F.col("k") * (radius + 1) + j).cast("int").alias("k"), F.col("fp").bitwiseAND(m).alias("bits")))
        more = keyed.join(large, ["k", "bits"], "left_semi").select("id", "fp", F.explode(again).alias("key")).select("id", "fp", "key.k", "key.bits")
        sized = sized.filter(F.col("n") <= shard_cap).unionByName(more.join(count(more), ["k", "bits"]))
    parts = F.ceil(F.col("n") / shard_cap).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A part meets itself and every other part once: cell (i, j) with i <= j holds the tree of i and the searches of j.
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    dealt = (
        sized.withColumn("parts", parts)
        .withColumn("mine", mine)
        .select("id", "fp", "k", "bits", "mine", F.explode(cells).alias("cell"))
        .select("id", "fp", "mine", F.xxhash64("k", "bits", "cell.i", "cell.j").alias("shard"), "k", "bits", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"a": [], "b": []}
        key, tree, search = None, [], []

        def done() -> None:
            if key is not None:
                for a, b in joining(tree, search if key[2] != key[3] else None, radius):
                    held["a"].append(a)
                    held["b"].append(b)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("k", "bits", "i", "j", "fp", "id", "mine")]
            for k, bits, i, j, fp, node, part in zip(*cols, strict=True):
                if (now := (k, bits, i, j)) != key:
                    done()
                    key, tree, search = now, [], []
                (tree if part == i else search).append((fp & (2**64 - 1), node))
            if len(held["a"]) > 10_000:
                yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in held.items()})
                held = {"a": [], "b": []}
        done()
        yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in held.items()})

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "shard").sortWithinPartitions("k", "bits", "i", "j").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row with 16 hex digits and the smallest id reachable.

    Texts without words (null, empty, white space) have fingerprint zero and link like any other. Rows that repeat an id
    stay apart as rows; each goes with its own text's fingerprint. A row with a null id is in the component of its
    fingerprint but never names one; a component of null ids only has a null id. An empty table gives an empty result.
    """
    rows = staged(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    # One node a fingerprint, so a fingerprint links others whatever ids it has.
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius=radius))
    labels = staged(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "id", "n", F.coalesce("component", "fp").alias("component")))
    least = staged(labels.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("w")))
    named = staged(looked_up(labels, least, "component", "w").select("fp", "n", "component_id"))
    return looked_up(rows, named, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, by SimHash, BK-trees and a check.

At 0.8 two SimHashes differ in about one bit of seven, far beyond what one fingerprint's radius can be sharded for. So a
text has several fingerprints of other seeds, cut into bands, and goes to a shard for each band: two texts at 0.8 share
a shard with a chance of `RECALL` at least, more similar ones with more. Bands grow with the logarithm of the number of
texts, so that shards of unrelated texts don't grow, and their number follows from the chance (see `bands_for`). A
BK-tree over the shard, on 128 bits, finds the texts that have another within the radius; these are read again, and only
pairs whose shingles pass are linked. A shard of more than `cap` texts is cut into parts, and every two parts meet in a
cell of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.arrays import U, Words, mix, normal, spans
from cardloom.llm.components import components
from cardloom.llm.shared import looked_up, sifted, staged, sub_batches, texts
from cardloom.llm.simhash import _LANES, SEED, BKTree

SHINGLE, SIMILARITY = 5, 0.8
#: Least chance that texts of the least similarity share a shard, least bits of a band, unrelated texts to a shard, and
#: the radius in the 128 bits of a band's fingerprint and the next.
RECALL, BAND, SHARD, RADIUS = 0.99, 16, 64, 30
#: Most large shards whose numbers of parts are broadcast.
MOST_LARGE = 100_000


def bands_for(texts: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(fingerprints of a text, bits of a band) for so many texts: 16 and 16 up to four million.

    A bit of two texts' fingerprints agrees with a chance that follows from the angle between their shingle sets.
    """
    band = max(BAND, math.ceil(math.log2(max(texts, 1) / SHARD)))
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bands = math.ceil(math.log(1 - RECALL) / math.log1p(-(agree**band)))
    return -(-bands // (64 // band)), band


def shingles_of(batch: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of every text, one text after the other, and how many each has."""
    words = Words([normal(t.lower()) for t in batch])
    n = np.diff(words.first)
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(batch)), count)
    first = words.first[:-1][doc] + spans(count)
    last = np.minimum(first + shingle, words.first[1:][doc]) - 1
    pieces = map(words.data.__getitem__, map(slice, words.starts[first].tolist(), words.ends[last].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), U, len(doc))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(doc) != 0) | (h[1:] != h[:-1])
    return h[new], np.bincount(doc[new], minlength=len(batch))


def prints_of(h: np.ndarray, count: np.ndarray, prints: int) -> np.ndarray:
    """SimHashes of the texts that have shingles, so many across."""
    count = count[count > 0]
    out = np.zeros((len(count), prints), U)
    if not len(count):
        return out
    # Eight counters to a word, summed over at most 255 shingles at a time.
    cut = np.flatnonzero(spans(count) % 255 == 0)
    starts = np.searchsorted(cut, np.cumsum(count) - count)
    for f in range(prints):
        planes = mix(h + U((f + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))).view(np.uint8).reshape(-1, 8)
        for p in range(8):
            part = np.add.reduceat(_LANES[planes[:, p]], cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
            bits = (2 * np.add.reduceat(part, starts, axis=0) > count[:, None]).astype(U)
            out[:, f] |= (bits << np.arange(8, dtype=U)).sum(axis=1, dtype=U) << U(8 * p)
    return out


def near_clusters(tree_side: list[tuple], search_side: list[tuple] | None) -> list[list]:
    """The nodes that others within the radius lead to, by cluster; None searches the tree's own side."""
    tree, owners, parent = BKTree(), [], {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for fp, node in tree_side:
        at = tree.add(fp)
        if at == len(owners):
            owners.append([])
        owners[at].append(node)
    for fp, node in tree_side if search_side is None else search_side:
        for at in tree.within(fp, RADIUS):
            for o in owners[at]:
                if o != node and (x := root(o)) != (y := root(node)):
                    parent[x] = y
    found: dict = {}
    for x in parent:
        found.setdefault(root(x), []).append(x)
    return [sorted(c) for c in found.values()]


def similar_links(nodes: list, h: np.ndarray, count: np.ndarray, similarity: float) -> list[tuple]:
    """Links that join what is similar, without those that close a cycle; `h` has the nodes' shingles, `count` of each."""
    _, code = np.unique(h, return_inverse=True)
    ends = np.cumsum(count)
    starts = ends - count
    mark = np.zeros(len(h), np.int32)
    group, out = np.arange(len(nodes)), []
    for x in range(1, len(nodes)):
        mark[code[starts[x] : ends[x]]] = 1
        both = np.add.reduceat(mark[code[: starts[x]]], starts[:x])
        mark[code[starts[x] : ends[x]]] = 0
        hits = np.flatnonzero(both >= similarity * (count[:x] + count[x] - both) - 1e-9)
        names, at = np.unique(group[hits], return_index=True)
        for name, y in zip(names.tolist(), hits[at].tolist(), strict=True):
            if name != group[x]:
                out.append((nodes[y], nodes[x]))
                group[group == name] = group[x]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of every key, which come sorted; keys of one row are left out."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in keys + names), strict=True):
            if (key := row[: len(keys)]) != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = key, []
            rows.append(row[len(keys) :])
    if len(rows) > 1:
        yield now, rows


def links(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, cap: int = 512) -> DataFrame:
    """(a, b): nodes of `docs` (node, text) that are similar, enough of them to connect all that are found. A node is a long or a binary of a text."""
    across, band = bands_for(docs.count(), similarity)
    kind = docs.schema["node"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "binary": pa.binary()}[kind]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text", 2 << 20):
            h, count = shingles_of(texts(b, "text"), shingle)
            found = pa.FixedSizeListArray.from_arrays(pa.array(prints_of(h, count, across).view(np.int64).ravel()), across).cast(pa.list_(pa.int64()))
            yield pa.record_batch({"node": b.column("node").filter(pa.array(count > 0)), "prints": found})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"cluster": [], "node": []}
        table = lambda: pa.record_batch({"cluster": pa.array(held["cluster"], pa.int64()), "node": pa.array(held["node"], arrow)})
        whole = lambda a, b: (a & (2**64 - 1)) << 64 | b & (2**64 - 1)
        for (_, i, j), rows in _runs(batches, ("key", "i", "j"), ("node", "mine", "one", "two")):
            sides = {t: [(whole(a, b), node) for node, mine, a, b in rows if (mine == i) == t] for t in (True, False)}
            for nodes in near_clusters(sides[True], None if i == j else sides[False]):
                # Named by its nodes: the same cluster of another band is the same.
                name = xxhash.xxh64_intdigest(b"".join(x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True) for x in nodes), SEED)
                held["cluster"] += [name - (name >> 63 << 64)] * len(nodes)
                held["node"] += nodes
            if len(held["node"]) > 10_000:
                yield table()
                held = {"cluster": [], "node": []}
        yield table()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[pa.RecordBatch]:
            for b in sub_batches(batches, "text", 2 << 20):
                h, count = shingles_of(texts(b, "text"), shingle)
                sets = [h[e - n : e].tobytes() for e, n in zip(np.cumsum(count).tolist(), count.tolist(), strict=True)]
                yield pa.record_batch({"cluster": b.column("cluster"), "node": b.column("node"), "set": pa.array(sets, pa.binary())})

        for _, rows in _runs(hashed(), ("cluster",), ("node", "set")):
            nodes, sets = zip(*rows, strict=True)
            if found := similar_links(list(nodes), np.frombuffer(b"".join(sets), U), np.array([len(x) // 8 for x in sets]), similarity):
                yield pa.record_batch({"a": pa.array([a for a, _ in found], arrow), "b": pa.array([b for _, b in found], arrow)})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = staged(docs.mapInArrow(sketch, f"node {kind}, prints array<long>")).dropDuplicates(["node"])
    # Every band as its number and its bits, with its fingerprint and the next.
    per = 64 // band
    at = lambda k, more: F.element_at("prints", ((F.floor(k / per) + more) % across + 1).cast("int"))
    spread = prints.select("node", "prints", F.explode(F.sequence(F.lit(0), F.lit(across * per - 1))).alias("k"))
    spread = spread.select("node", "k", at(F.col("k"), 0).alias("one"), at(F.col("k"), 1).alias("two"), (F.col("k") % per * band).cast("int").alias("shift"))
    keyed = spread.select("node", (F.col("k").cast("long") * (1 << band) + F.expr("shiftrightunsigned(one, shift)").bitwiseAND(F.lit((1 << band) - 1))).alias("key"), "one", "two")
    # Only shards over the cap need their size; where they are many, they are shuffled.
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("key", F.ceil(F.col("n") / cap).cast("int").alias("parts"))
    large = staged(large)
    large = F.broadcast(large) if large.count() <= MOST_LARGE else large
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # A part meets itself and every other part once: cell (i, j) with i <= j has the tree of i and the searches of j.
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    parted = keyed.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", mine)
    dealt = parted.select("key", "node", "mine", "one", "two", F.explode(cells).alias("c")).select("key", "c.i", "c.j", "node", "mine", "one", "two")
    near = staged(dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(search, f"cluster long, node {kind}").distinct())
    # Texts of no cluster are left out before the join.
    named = staged(near.select("node").distinct())
    some = sifted(docs, F.xxhash64("node"), named.select(F.xxhash64("node").alias("key"))).filter("maybe").drop("maybe")
    read = some.join(named, "node", "left_semi").dropDuplicates(["node"])
    return near.join(read, "node").repartition(n, "cluster").sortWithinPartitions("cluster").mapInArrow(check, f"a {kind}, b {kind}")


def _node(text_col: str) -> Column:
    """A text's name: 128 bits of its SHA-256; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))


def _labels(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """(node, n, component_id, rep_node, ties): of every text its rows, and its component's smallest id, the text of that and how many rows have both; staged."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _node(text_col).alias("node"), F.col(text_col).alias("text"))
    by_id = rows.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    best = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("c").alias("c"))
    nodes = by_id.groupBy("node").agg(F.min(best).alias("best"), F.sum("c").alias("n"))
    found = components(links(rows.select("node", "text"), similarity=similarity, shingle=shingle))
    named = staged(nodes.join(found, "node", "left").select("node", "n", "best", F.coalesce("component", "node").alias("component")))
    top = F.struct("best.unknown", "best.id", "node", "best.c")
    least = staged(named.groupBy("component").agg(F.min(top).alias("top"), F.count(F.lit(1)).alias("w")))
    return staged(looked_up(named, least, "component", "w").select("node", "n", F.col("top.id").alias("component_id"), F.col("top.node").alias("rep_node"), F.col("top.c").alias("ties")))


def near_text_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id): one row per input row with the smallest id that similar texts lead to.

    Equal texts are one node, whatever their ids, null as empty; texts without words are similar to equal texts only. A
    row with a null id is in its text's component but never names one. An empty table gives an empty result.
    """
    labels = _labels(docs, id_col, text_col, similarity, shingle)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _node(text_col).alias("node"))
    return looked_up(rows, labels, "node", "n").select("doc_id", "component_id")


def near_deduped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that stay, all columns as they were: exactly one of each component, of the smallest id (a null id comes last).

    Rows are told apart by their texts, so a row stays whatever rows share its id. Of rows that repeat id and text one stays.
    """
    labels = _labels(docs, id_col, text_col, similarity, shingle)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("_id"), _node(text_col).alias("node"))
    # The only row of a text that stands for its component stays without a join; only what may go travels.
    sift = sifted(rows, F.xxhash64("node"), staged(labels.filter("n > 1 OR node <> rep_node").select(F.xxhash64("node").alias("key"))))
    sure = sift.filter("NOT maybe").select("row.*")
    stay = looked_up(sift.filter("maybe").drop("maybe"), labels, "node", "n").filter((F.col("node") == F.col("rep_node")) & F.col("_id").eqNullSafe(F.col("component_id")))
    if not labels.filter("node = rep_node AND ties > 1").limit(1).count():
        return sure.union(stay.select("row.*"))
    one = stay.filter("ties > 1").groupBy("node").agg(F.first("row").alias("row"))
    return sure.union(stay.filter("ties = 1").select("row.*")).union(one.select("row.*"))

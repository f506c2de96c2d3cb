"""Texts whose sets of word shingles have a Jaccard similarity of at least 0.8, by R-trees over count vectors.

A set's shingles are hashed into about as many groups as it has shingles, 256 at least; their counts are a point, and two sets share at most the sum of the smaller
counts. An R-tree keeps of every subtree the largest count of each group and the smallest and largest set, so a search
passes over subtrees that can't reach the overlap that the similarity needs. What is left is compared shingle by shingle.

Trees stand over shards of which linked sets share at least one: all sets that have a certain shingle in their prefix,
the part of a set that two similar ones can't both keep free of common shingles. Prefixes take rare shingles first:
frequent ones (counted over all texts; a bounded list) come last, the others by their hash.

1. Equal sets become one node. A prefix shingle that several nodes of fitting sizes have makes a shard; of shards with the
   same nodes one is left.
2. *Candidates*: trees of points join the nodes of a shard that may be similar into groups. Where shards are large, every
   node first goes to the shards of its least and its greatest shingle, dealt in parts, differently for the two, so that a
   large group grows together across its parts; then come the shards whose nodes aren't all in one group, large ones part
   by part.
3. *Links*: every node of a group comes once with its set to be compared; large groups are dealt in parts twice, and
   part by part only if they haven't grown together by then.

Shards emit what joins components, fewer pairs than they have nodes, so neither candidates nor links of a group are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.arrays import U, Words, mix, normal
from cardloom.llm.components import components
from cardloom.llm.shared import discard, looked_up, sifted, staged, sub_batches, texts

SHINGLE, PERCENT, GROUPS = 5, 80, 256
#: Frequent shingles that are ranked last: at most so many, and none in fewer prefixes than this.
MOST_HOT, LEAST_HOT = 500_000, 64
CAP, TEXT_BYTES = 4096, 1 << 20
#: Shingles of the sets that are compared in one task, about.
MOST_TOKENS = 1 << 22
#: Sets looked up without a shuffle of the texts: so many names of 33 bytes go to every task; more are joined.
MOST_PLACES = 500_000
_MARKS = "doc_id long, place long, node binary, n long, prefix array<long>, hot array<long>, counts binary"


def shingle_sets(batch: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Of every text the sorted hashes of its distinct shingles; A-Z are lower-cased, fewer words than a shingle make one."""
    words = Words([normal(t.lower()) for t in batch])
    codes, out = words.codes(), []
    factors = [U(pow(0x9E3779B97F4A7C15, i + 1, 2**64)) for i in range(size)]
    n = max(0, len(codes) - size + 1)
    whole = np.zeros(n, U)
    for i, f in enumerate(factors):
        whole += codes[i : i + n] * f
    whole = mix(whole)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            h = np.sort(whole[a : b - size + 1])
            out.append(h[np.r_[True, h[1:] != h[:-1]]])
        elif b > a:  # the length keeps it apart from longer ones
            with np.errstate(over="ignore"):
                out.append(mix((codes[a:b] * np.array(factors[: b - a])).sum(keepdims=True, dtype=U) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def needed(n: int, percent: int) -> int:
    """Shingles that a set of `n` shares at least with a similar one."""
    return -(-percent * n // 100)


def prefix_of(tokens: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a sorted set, the shingles of the sorted list `hot` last, in two parts: those that aren't frequent, and those that are."""
    length = len(tokens) - needed(len(tokens), percent) + 1 if len(tokens) else 0
    if not len(hot):
        return tokens[:length], tokens[:0]
    frequent = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
    rare = tokens[~frequent][:length]
    return rare, tokens[frequent][: length - len(rare)]


def points(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """Count vectors of sets in so many groups, a row each; 255 and more as 255 (see `loaded`)."""
    return np.array([point(s, groups) for s in sets], np.uint8).reshape(-1, groups)


def point(tokens: np.ndarray, groups: int | None = None) -> np.ndarray:
    """A set's count vector, in a power of two of groups: the fewer than twice that many shingles it has, but 256 at least."""
    groups = groups or max(GROUPS, 1 << max(0, len(tokens).bit_length() - 1))
    return np.minimum(np.bincount((tokens % U(groups)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def packed(counts: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """A count vector as it travels; most counts are 0 to 4."""
    return pack.compress(counts.tobytes())


def unpacked(blobs: tuple[bytes, ...]) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(b), np.uint8) for b in blobs]


def folded(counts: np.ndarray) -> np.ndarray:
    """Loaded count vectors in half as many groups."""
    half = counts.shape[-1] // 2
    return np.minimum(counts[..., :half].astype(np.uint32) + counts[..., half:], 65_535).astype(np.uint16)


def loaded(counts: np.ndarray) -> np.ndarray:
    """Count vectors to compute with: a full counter bounds nothing."""
    wide = counts.astype(np.uint16)
    wide[counts == 255] = 65_535
    return wide


class CountTree:
    """An R-tree over count vectors, halved along the most varied group until `leaf` are left; nodes in heap order."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = 16):
        self.counts, self.sizes = counts, sizes
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(sizes)) / leaf))))
        parts = [np.arange(len(sizes))]
        for _ in range(self.depth):
            parts = [half for p in parts for half in self._halves(p)]
        self.leaves = parts
        # Corners of every node from the leaves up.
        inner = 2**self.depth - 1
        self.high = np.zeros((inner + len(parts), counts.shape[1]), counts.dtype)
        self.least, self.most = np.full(inner + len(parts), np.iinfo(np.int64).max), np.full(inner + len(parts), -1)
        for i, p in enumerate(parts):
            if len(p):
                self.high[inner + i], self.least[inner + i], self.most[inner + i] = counts[p].max(axis=0), sizes[p].min(), sizes[p].max()
        for i in range(inner - 1, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            self.high[i], self.least[i], self.most[i] = np.maximum(self.high[a], self.high[b]), min(self.least[a], self.least[b]), max(self.most[a], self.most[b])

    def _halves(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(part) < 2:
            return part, part[:0]
        column = self.counts[part][:, self.counts[part].astype(np.float32).var(axis=0).argmax()]
        order = part[np.lexsort((self.sizes[part], column))]
        return order[: len(order) // 2], order[len(order) // 2 :]

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indexes of all sets that may be similar to a set of `size` at `point`."""
        at = np.zeros(1, np.int64)
        for level in range(self.depth + 1):
            at = at[may_link(point, size, self.high[at], self.least[at], self.most[at], percent)]
            if not len(at):
                return at
            if level < self.depth:
                at = np.r_[2 * at + 1, 2 * at + 2]
        found = np.concatenate([self.leaves[i] for i in (at - (2**self.depth - 1)).tolist()])
        return found[may_link(point, size, self.counts[found], self.sizes[found], self.sizes[found], percent)]


def may_link(point: np.ndarray, size: int, high: np.ndarray, least: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    """Whether boxes with the upper corner `high` and sets of `least` to `most` shingles may hold one similar to `size` at `point`."""
    overlap = np.minimum(np.minimum(high, point).sum(axis=1, dtype=np.int64), np.minimum(size, most))
    # overlap of union needs (100 + percent) * overlap >= percent * (both sizes)
    return ((100 + percent) * overlap >= percent * (size + least)) & (100 * most >= percent * size) & (100 * size >= percent * least)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(b) < len(a):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


class Points:
    """Count vectors of several widths. Similar sets have as many groups, or one twice as many as the other."""

    def __init__(self, counts: list[np.ndarray], sizes: np.ndarray, percent: int, leaf: int = 16):
        self.counts, self.sizes, self.percent = counts, sizes, percent
        self.width = np.array([len(c) for c in counts])
        self.bands = {}
        for groups in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == groups)
            at = loaded(np.stack([counts[i] for i in own]))
            self.bands[groups] = own, at, CountTree(at, sizes[own], leaf) if len(own) > leaf else None

    def near(self, i: int) -> np.ndarray:
        """Sets that may be similar to set i, of its width or half of it; wider ones find it themselves."""
        out, vector = [], loaded(self.counts[i])
        for groups in (int(self.width[i]), int(self.width[i]) // 2):
            if groups in self.bands:
                own, at, tree = self.bands[groups]
                vector = vector if len(vector) == groups else folded(vector)
                out.append(own[tree.search(vector, self.sizes[i], self.percent) if tree else may_link(vector, self.sizes[i], at, self.sizes[own], self.sizes[own], self.percent)])
        return np.concatenate(out)


def joining(points_: Points, labels: np.ndarray, side: np.ndarray | None = None, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs (index, index) that connect what may be similar, or with `sets` what is, without those inside one component.

    `labels` start the components. With `side`, only sets on different sides are paired.
    """
    label, out = labels.copy(), []
    for i in range(len(label)):
        if (label == label[i]).all():
            break
        near = points_.near(i)
        near = near[label[near] != label[i]]
        if side is not None:
            near = near[side[near] != side[i]]
        for j in near.tolist():
            if label[j] != label[i] and (sets is None or similar(sets[i], sets[j], points_.percent)):
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def frequent(docs: DataFrame, *, size: int, percent: int, most: int, least: int) -> np.ndarray:
    """The shingles in most prefixes by hash alone, sorted: those over a threshold, at most `most`. One that only moves up into prefixes isn't counted there; any list gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text", TEXT_BYTES):
            heads = [s[: len(s) - needed(len(s), percent) + 1] for s in shingle_sets(texts(b, "text"), size)]
            yield pa.record_batch({"token": pa.array(np.concatenate([*heads, np.zeros(0, U)]).view(np.int64))})

    counted = docs.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    many = staged(counted.filter(F.col("n") > least).withColumn("power", F.floor(F.log2("n")).cast("int")))
    left, above = most, None
    for r in many.groupBy("power").count().orderBy(F.desc("power")).collect():
        if (left := left - r["count"]) < 0:
            break
        above = r.power
    found = [] if above is None else [r.token for r in many.filter(F.col("power") >= above).select("token").collect()]
    discard(many)
    return np.sort(np.array(found, np.int64).view(U))


def marks(docs: DataFrame, hot: np.ndarray, *, size: int, percent: int) -> DataFrame:
    """One row a document (doc_id, place, text): its set's name (null if empty) and size; of each set that a task sees, once the prefix in two parts and the count vector."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pack = set(), zstandard.ZstdCompressor(level=3)
        for b in sub_batches(batches, "text", TEXT_BYTES):
            sets = shingle_sets(texts(b, "text"), size)
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            fresh = []
            for name in names:
                fresh.append(name is not None and name not in seen)
                seen.add(name)
            heads = [prefix_of(s, shared.value, percent) if new else None for s, new in zip(sets, fresh, strict=True)]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "place": b.column("place"), "node": pa.array(names, pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()),
                "prefix": _lists([h and h[0] for h in heads]), "hot": _lists([h and h[1] for h in heads]),
                "counts": pa.array([packed(point(s), pack) if new else None for s, new in zip(sets, fresh, strict=True)], pa.binary()),
            })

    return docs.select("doc_id", "place", "text").mapInArrow(run, _MARKS)


def _lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)])
    values = pa.array(np.concatenate([*(a for a in arrays if a is not None), np.zeros(0, U)]).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([a is None for a in arrays], pa.bool_()))


def shared_tokens(rows: DataFrame, percent: int) -> DataFrame:
    """(token, node): the prefix shingles that several nodes of fitting sizes have; of frequent ones all, which are dealt by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fits = None, False  # the last row waits for the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # A node that several tasks have seen stands there several times.
            node, token = batch.column("node").to_numpy(zero_copy_only=False), np.asarray(batch.column("token"))
            last = np.r_[(node[1:] != node[:-1]) | (token[1:] != token[:-1]), True]
            batch, token = batch.filter(pa.array(last)), token[last]
            n = np.asarray(batch.column("n"))
            # Sorted by size, so the nearest size stands beside a row.
            near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = np.r_[fits, near] | np.r_[near, False]
            yield batch.slice(0, len(keep) - 1).filter(pa.array(keep[:-1])).select(["token", "node"])
            held, fits = batch.slice(len(keep) - 1), bool(keep[-1])
        if held is not None and fits:
            yield held.select(["token", "node"])

    rare = rows.select(F.explode("prefix").alias("token"), "n", "node").repartition("token").sortWithinPartitions("token", "n", "node")
    return rare.mapInArrow(run, "token long, node binary").unionByName(rows.select(F.explode("hot").alias("token"), "node").distinct())


def distinct_shards(shards: DataFrame) -> DataFrame:
    """`shards` (token, node) without those that have the nodes of another one, told by 128 bits of them, or a single node."""
    mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    each = shards.groupBy("token").agg(F.count(F.lit(1)).alias("w"), mark(1).alias("x"), mark(2).alias("y"))
    one = staged(each.filter("w > 1").groupBy("w", "x", "y").agg(F.min("token").alias("token")).select("token", "w"))
    # Most shingles' shards are left out, before the join.
    some = sifted(shards, F.col("token"), one.select(F.col("token").alias("key"))).filter("maybe").drop("maybe")
    out = staged(looked_up(some, one, "token", "w").filter("w IS NOT NULL").select("token", "node"))
    discard(one)
    return out


def _dealt(rows: DataFrame, cap: int) -> DataFrame:
    """`rows` (token, node, ...) with `parts`, how many parts of about `cap` nodes the shard has, and of `MOST_TOKENS` if rows have their `n`."""
    tokens = F.sum("n") if "n" in rows.columns else F.lit(0)
    sizes = staged(rows.groupBy("token").agg(F.count(F.lit(1)).alias("w"), tokens.alias("tokens")))
    parts = F.greatest(F.ceil(F.col("w") / cap), F.ceil(F.col("tokens") / MOST_TOKENS)).cast("int")
    large = sizes.withColumn("parts", parts).filter("parts > 1")
    return looked_up(rows, large.select("token", "w", "parts"), "token", "w").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _sharded(rows: DataFrame, by: list[str], columns: list[str], work, schema: str) -> DataFrame:
    """`work` on every group of `by`, given lists of `columns`; the groups of a task one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        names = [f.split(" ")[0] for f in schema.split(", ")]
        kinds = [pa.binary() if f.endswith(" binary") else pa.int64() if f.endswith(" long") else pa.int32() for f in schema.split(", ")]

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, list(zip(*out, strict=True)) or [()] * len(names), kinds, strict=True)})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in by + columns), strict=True):
                if row[: len(by)] != key:
                    if len(held) > 1:
                        yield made(work(key, list(zip(*held, strict=True))))
                    key, held = row[: len(by)], []
                held.append(row[len(by) :])
        yield made(work(key, list(zip(*held, strict=True))) if len(held) > 1 else [])

    return rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _labels(values: tuple) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(v, len(known)) for v in values])


def similarity_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, cap: int = CAP, most_hot: int = MOST_HOT, least_hot: int = LEAST_HOT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id reachable by links: one row an input row.

    Two documents link when 100 * shared >= `percent` * united shingles; shingles are told apart by 64-bit hashes and sets by 128-bit ones.
    Texts without words (null, empty, white space) have no shingles, link with nothing and are their own component, null if
    their id is. Rows that repeat an id stay apart as rows. A null id never names a component but where it is alone in it.
    An empty table gives an empty result; other columns are ignored, whatever their names. No limit drops a pair:
    `cap`, `most_hot` and `least_hot` only deal the work.
    """
    # A row's place is a hash of all that matters of it, so that one row of each node finds its text again.
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("place"))
    hot = frequent(docs, size=size, percent=percent, most=most_hot, least=least_hot)
    marked = staged(marks(docs, hot, size=size, percent=percent))
    rows = staged(marked.select("doc_id", "node", "n"))
    # Equal sets have equal marks, so any of them stands for all.
    nodes = staged(marked.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("place").alias("place"), F.count(F.lit(1)).alias("w"), F.max("n").alias("n"), F.first("counts", ignorenulls=True).alias("counts")))
    every = staged(shared_tokens(marked, percent))
    discard(marked)
    shards = distinct_shards(every)
    discard(every)
    points_ = nodes.select("node", "n", "counts")

    labelled, some = shards.withColumn("label", F.col("node")), None
    if shards.groupBy("token").count().filter(F.col("count") > cap).limit(1).count():
        ends = F.array(F.struct(F.min("token").alias("token"), F.lit(0).alias("side")), F.struct(F.max("token").alias("token"), F.lit(1).alias("side")))
        twice = shards.groupBy("node").agg(F.explode(ends).alias("at")).select(F.xxhash64("at.token", "at.side").alias("token"), "node", F.col("node").alias("label"))
        some = _joined(_apart(twice, cap), points_, percent)
        labelled, _ = _open(shards.join(components(some), "node", "left").select("token", "node", F.coalesce("component", "node").alias("label")))
    more = _joined(_across(labelled, cap), points_, percent)
    groups = components(more if some is None else some.unionByName(more))

    # Every node of a group with its group, so that its set travels once, to its group's task.
    grouped = groups.join(nodes.select("node", "place", "n"), "node").select(F.xxhash64("component").alias("token"), "node", F.col("node").alias("label"), "place", "n")
    sized = staged(_dealt(grouped, cap))
    sets = staged(_sets(docs, sized.select("place", "node", F.when(F.col("parts") == 1, F.col("token")).alias("token")), size))
    # A group of one part is settled by its task; the parts of others meet as components of their links.
    alone = sets.filter("token IS NOT NULL").select("token", "node", F.col("node").alias("label"), *(F.lit(0).alias(c) for c in ("mine", "i", "j")), "tokens")
    found, links, last = _joined(alone, None, percent, classes=True), None, None
    if sized.filter("parts > 1").limit(1).count():
        wide = sets.filter("token IS NULL").select("node", "tokens")
        dealt = sized.filter("parts > 1").withColumn("deal", F.explode(F.array(F.lit(0), F.lit(1))))
        part = F.pmod(F.xxhash64("node", "deal"), "parts").cast("int")
        links = _joined(dealt.select(F.xxhash64("token", "deal").alias("token"), "node", "label", part.alias("mine"), part.alias("i"), part.alias("j")), wide, percent)
        grown = components(links)
        opened, any_ = _open(sized.filter("parts > 1").select("token", "node", "n").join(grown, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("label")))
        if any_:
            last = _joined(_across(opened, cap), wide, percent)
            grown = components(links.unionByName(last))
        found = found.unionByName(grown)

    labels = staged(nodes.join(found, "node", "left").select("node", "id", "w", F.coalesce("component", "node").alias("component")))
    least = staged(labels.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("k")))
    named = staged(looked_up(labels, least, "component", "k").select("node", "w", "component_id"))
    for spent in filter(None, (nodes, shards, some, more, sets, sized, links, last, labels, least)):
        discard(spent)
    out = looked_up(rows, named, "node", "w")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _apart(rows: DataFrame, cap: int) -> DataFrame:
    """Cells of `rows` (token, node, label): each part of a shard by itself."""
    part = F.pmod(F.xxhash64("node", "token"), "parts").cast("int")
    return _dealt(rows, cap).select("token", "node", "label", part.alias("mine"), part.alias("i"), part.alias("j"))


def _across(rows: DataFrame, cap: int) -> DataFrame:
    """Cells of `rows` (token, node, label): each part of a shard by itself and with every other one."""
    parted = _dealt(rows, cap).withColumn("mine", F.pmod(F.xxhash64("node", "token"), "parts").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    return parted.select("token", "node", "label", "mine", F.explode(cells).alias("cell")).select("token", "node", "label", "mine", "cell.i", "cell.j")


def _open(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (token, node, label) of shards with several labels, and whether there are any."""
    rows = staged(rows)
    several = staged(rows.groupBy("token").agg(F.count(F.lit(1)).alias("w"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").drop("a", "b"))
    return looked_up(rows, several, "token", "w").filter("w IS NOT NULL").drop("w"), several.limit(1).count()


def _joined(cells: DataFrame, having: DataFrame | None, percent: int, *, classes: bool = False) -> DataFrame:
    """(a, b) that join the components (label) of the nodes of each cell (token, i, j), of one part or of parts i and j.

    `having` (node, n, counts) gives what may be similar, `having` (node, tokens) what is; None: cells have their tokens. With `classes`, (node,
    component) of the nodes that are joined instead, as `components` would have it.
    """
    exact = having is None or "tokens" in having.columns

    def work(key: tuple, columns: list[tuple]) -> list[tuple]:
        names, labels, mine = columns[:3]
        side = None if key[1] == key[2] else np.array([int(m != key[1]) for m in mine])
        sets = [np.frombuffer(t, U) for t in columns[3]] if exact else None
        counts = [point(s) for s in sets] if exact else unpacked(columns[4])
        sizes = np.array([len(s) for s in sets] if exact else columns[3], np.int64)
        pairs = joining(Points(counts, sizes, percent), _labels(labels), side, sets)
        if not classes:
            return [(names[a], names[b]) for a, b in pairs]
        group = np.arange(len(names))
        for a, b in pairs:
            group[group == group[b]] = group[a]
        least: dict[int, bytes] = {}
        for name, g in zip(names, group.tolist(), strict=True):
            least[g] = min(name, least.get(g, name))
        size = np.bincount(group)
        return [(name, least[g]) for name, g in zip(names, group.tolist(), strict=True) if size[g] > 1]

    schema = "node binary, component binary" if classes else "a binary, b binary"
    more = ["tokens"] if having is None else having.columns[1:]
    rows = cells if having is None else cells.join(having, "node")
    return staged(_sharded(rows, ["token", "i", "j"], ["node", "label", "mine", *more], work, schema))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(token, node, tokens): the sets of `wanted` (place, node, token), whose texts are read again."""
    wanted = staged(wanted)
    few = wanted.count() <= MOST_PLACES
    table = wanted.toArrow() if few else None
    known = None
    if few:
        place, name = np.asarray(table.column("place")), np.frombuffer(b"".join(table.column("node").to_pylist()), "V16")
        token, alone = np.asarray(table.column("token").fill_null(0)), np.asarray(table.column("token").is_valid())
        order = np.argsort(place, kind="stable")
        known = docs.sparkSession.sparkContext.broadcast((place[order], name[order], token[order], alone[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows share their place
        for b in sub_batches(batches, "text", TEXT_BYTES):
            if known:  # all names of the row's place, one as a rule
                places, names, tokens, alone = known.value
                here = np.asarray(b.column("place"))
                low, past = np.searchsorted(places, here, "left"), np.searchsorted(places, here, "right")
                at = np.flatnonzero(past > low)
                picked, want = b.take(pa.array(at)), [{bytes(names[k]): tokens[k].item() if alone[k] else None for k in range(low[i], past[i])} for i in at.tolist()]
            else:
                picked, want = b, [{w: t} for w, t in zip(b.column("node").to_pylist(), b.column("token").to_pylist(), strict=True)]
            keep = []
            for s, names in zip(shingle_sets(texts(picked, "text"), size), want, strict=True):
                name = xxhash.xxh3_128_digest(s.tobytes())
                if name in names and name not in seen:
                    seen.add(name)
                    keep.append((names[name], name, s.tobytes()))
            group, node, own = zip(*keep, strict=True) if keep else ((), (), ())
            yield pa.record_batch({"token": pa.array(group, pa.int64()), "node": pa.array(node, pa.binary()), "tokens": pa.array(own, pa.binary())})

    picked = docs.select("place", "text") if few else docs.join(wanted, "place").select("place", "node", "token", "text")
    return picked.mapInArrow(run, "token long, node binary, tokens binary")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), five AS (
  SELECT doc_id, unnest(w[1:len(w) - 4]) AS a, unnest(w[2:len(w) - 3]) AS b, unnest(w[3:len(w) - 2]) AS c, unnest(w[4:len(w) - 1]) AS d, unnest(w[5:]) AS e
  FROM w WHERE len(w) >= 5
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, d, e) AS sh FROM five
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), edges AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ways AS MATERIALIZED (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN ways e ON e.a = r.seen
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(seen) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

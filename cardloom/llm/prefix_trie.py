"""The prefix trie of conversations by partition refinement.

All conversations start as one class, the root. A round takes the next turn of every member of the active classes and
splits each class by it; the parts are the nodes of that depth. A part of a single conversation is retired: the rest of
that conversation is a chain of nodes with one child each. A part of at most `most_convs` conversations and `most_turns`
turns to come is refined to its end by one task in the same way, many such parts to a task; larger ones stay active. What
the nodes of a subtree come to is folded back from the deepest level to the root.

Turns are rows throughout, so a conversation of any length is spread over many tasks, and members of large classes meet
their part as `looked_up` deals them. There are as many rounds as the deepest turn that a large class has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.shared import discard, looked_up, staged

BLOCK, HEADS = 20, 4
MOST_CONVS, MOST_TURNS = 256, 65_536
WORD = r"[^\x20\x09-\x0D]+"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def content(role: Column, text: Column) -> Column:
    """A digest of a turn; null counts as empty, and the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, words): every turn with its place in its conversation, from 0; rows without conv_id are left out.

    The order is that of `turn`, null first, then of the digest. Rows are sorted by ranges, so the turns of one conversation
    may lie in many tasks; what its tasks before have counted (one row a task) is added afterwards.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), content(F.col(role_col), F.col(text_col)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "digest", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = np.asarray(batch.column("conv_id"))
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            pos = np.arange(len(conv)) - np.repeat(starts, np.diff(np.r_[starts, len(conv)]))
            if conv[0] == last:
                pos[: starts[1] if len(starts) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(pos[-1]) + 1
            yield pa.record_batch({"part": pa.array(np.full(len(conv), part, np.int32)), "conv_id": batch.column("conv_id"), "local": pa.array(pos), "digest": batch.column("digest"), "words": batch.column("words")})

    local = staged(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words").mapInArrow(run, "part int, conv_id long, local long, digest binary, words long"))
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last")).orderBy("part").collect()
    offsets, conv, count = [], None, 0
    for r in ends:
        before = count if r["first"] == conv else 0
        if before:
            offsets.append((r.part, conv, before))
        conv, count = r["last"].conv_id, r["last"].local + 1 + (before if r["last"].conv_id == r["first"] else 0)
    if not offsets:
        return local.select("conv_id", F.col("local").alias("pos"), "digest", "words")
    more = local.sparkSession.createDataFrame(offsets, "o_part int, o_conv long, more long")
    both = local.join(F.broadcast(more), (F.col("part") == F.col("o_part")) & (F.col("conv_id") == F.col("o_conv")), "left")
    return both.select("conv_id", (F.col("local") + F.coalesce("more", F.lit(0))).alias("pos"), "digest", "words")


def rebuilt(ordered: DataFrame, *, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, digest, words) and (conv_id, n_turns), both staged: each conversation with its head taken from the first of its block.

    Conversation c gets the first h turns of conversation c - c % `block` and its own after its first h; h = crc32(c) % `heads`.
    """
    convs = ordered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    head = ordered.filter((F.col("conv_id") % block == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,words:bigint>>")), 1, F.col("h"))
    plan = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(head, "base", "left").withColumn("head", taken)
    plan = staged(plan.select("conv_id", "n_own", "head", "h", F.size("head").cast("long").alias("taken")))
    # Own turns shift only where the head is shorter than what it replaces.
    shift = plan.filter("taken < h").select("conv_id", "n_own", (F.col("h") - F.col("taken")).alias("short"))
    own = ordered.filter(F.col("pos") >= h)
    own = looked_up(own, shift, "conv_id", "n_own").select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0)) + 1).alias("d"), "digest", "words")
    given = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("d"), "t.digest", "t.words")
    rows = staged(own.unionByName(given).sortWithinPartitions("d"))
    n = F.col("taken") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))
    sizes = staged(plan.select("conv_id", n.alias("n_turns")))
    discard(plan)
    return rows, sizes


def refine(ids: list[int], sequences: list[list[tuple[bytes, int]]], depth: int, words: int, parent: int | None) -> list[tuple]:
    """The nodes of the class of `ids` at `depth`, top first; `sequences` are (digest, words) of the turns to come."""
    out: list[list] = []
    above: list[int] = []
    todo = [(list(range(len(ids))), depth, words, parent, -1)]
    while todo:
        members, d, w, parent, up = todo.pop()
        at = len(out)
        top = min(ids[i] for i in members)
        ends, parts = [], {}
        for i in members:
            if len(sequences[i]) == d - depth:
                ends.append(ids[i])
            else:
                parts.setdefault(sequences[i][d - depth][0], []).append(i)
        joined = ",".join(map(str, sorted(ends))).encode()
        out.append([top, d, parent, len(members), len(parts), 0, (len(members) - 1) * w, hashlib.sha256(joined).hexdigest()])
        above.append(up)
        if len(members) == 1 and parts:  # retired: a chain to the end
            end = depth + len(sequences[members[0]])
            empty = hashlib.sha256(b"").hexdigest()
            for n in range(d + 1, end + 1):
                last = n == end
                out.append([top, n, top, 1, int(not last), 0, 0, hashlib.sha256(str(top).encode()).hexdigest() if last else empty])
                above.append(len(out) - 2)
        else:
            todo += [(part, d + 1, sequences[part[0]][d - depth][1], top, at) for part in parts.values()]
    for at in range(len(out) - 1, -1, -1):  # every node stands behind the one above it
        out[at][5] = out[at][5] or 1
        if above[at] >= 0:
            out[above[at]][5] += out[at][5]
            out[above[at]][6] += out[at][6]
    return [tuple(x) for x in out]


def _finished(rows: DataFrame) -> DataFrame:
    """The nodes of the small classes: `rows` has for every member a row of the class's depth and one of each turn to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in _NODE.split(",")]
        key, head, ids, sequences, done = None, None, [], [], []

        def flush() -> None:
            if key is not None:
                done.extend((*node, i == 0) for i, node in enumerate(refine(ids, sequences, key[1], *head)))

        def made() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * (len(names) + 1)
            kinds = [pa.int64()] * (len(names) - 1) + [pa.string(), pa.bool_()]
            return pa.record_batch({n: pa.array(c, k) for n, c, k in zip([*names, "top"], columns, kinds, strict=True)})

        for batch in batches:
            for node, depth, parent, conv, d, digest, words in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "parent", "conv_id", "d", "digest", "words")), strict=True):
                if (node, depth) != key:
                    flush()
                    key, head, ids, sequences = (node, depth), (words, parent), [], []
                    if len(done) > 10_000:
                        yield made()
                        done = []
                if d == depth:
                    ids.append(conv)
                    sequences.append([])
                else:
                    sequences[-1].append((digest, words))
        flush()
        yield made()

    dealt = rows.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id", "d")
    return dealt.select("node", "depth", "parent", "conv_id", "d", "digest", "words").mapInArrow(run, _NODE + ", top boolean")


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of `ends` (node, depth, conv_id): SHA-256 of the ids of a node, ascending, joined by commas.

    Ids are sorted by ranges and every task joins its own, so a node's hash reads one string a task, in order.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, conv = (np.asarray(batch.column(c)) for c in ("node", "depth", "conv_id"))
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])
            stops = np.r_[starts[1:], len(conv)]
            yield pa.record_batch({"node": pa.array(node[starts]), "depth": pa.array(depth[starts]), "first": pa.array(conv[starts]), "ids": pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, stops, strict=True)])})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (node, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digest_rows(out)
        yield _digest_rows([(*key, sha.hexdigest())] if key else [])

    def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
        node, depth, digest = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch({"node": pa.array(node, pa.int64()), "depth": pa.array(depth, pa.int64()), "ends_sha256": pa.array(digest, pa.string())})

    order = ["node", "depth", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "node long, depth long, first long, ids string")
    return joined.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "ids").mapInArrow(hashed, "node long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_convs: int = MOST_CONVS, most_turns: int = MOST_TURNS) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations (see `rebuilt` and `nodes`).

    Rows without conv_id are left out, null roles and texts count as empty, rows that repeat a turn are turns of their own;
    an empty table gives an empty result, and other columns are ignored, whatever their names.
    """
    ordered = turns(conversations, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    rows, sizes = rebuilt(ordered)
    found = nodes(rows, sizes, most_convs=most_convs, most_turns=most_turns)
    for spent in (rows, sizes):
        discard(spent)
    return found


def nodes(rows: DataFrame, sizes: DataFrame, *, most_convs: int = MOST_CONVS, most_turns: int = MOST_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    `rows` (conv_id, d, digest, words) are the turns from d = 1, `sizes` (conv_id, n_turns) all conversations, turnless
    ones too; both are read again and again and should be staged. Repeated turns, ties and conversations that begin
    others need nothing special. Without conversations there is no node. The limits only move work between rounds and tasks.
    """
    spark = rows.sparkSession
    whole = sizes.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    if not whole.n:
        return spark.createDataFrame([], _NODE)
    # Large classes level by level: (node, parent, n, words); members of all classes that are left, with where they were left.
    levels = [spark.createDataFrame([(whole.conv, None, whole.n, 0)], "node long, parent long, n long, words long")]
    active = sizes.select("conv_id", "n_turns", F.lit(whole.conv).cast("long").alias("node"))
    ended = [active.filter("n_turns = 0").select("node", F.lit(0).cast("long").alias("depth"), "conv_id")]
    left, depth, spent = [], 0, []
    while True:
        depth += 1
        next_turn = rows.filter(F.col("d") == depth).select("conv_id", "digest", "words")
        taken = staged(active.filter(F.col("n_turns") >= depth).join(next_turn, "conv_id").withColumn("key", F.concat_ws(":", F.col("node"), F.hex("digest"))))
        parts = staged(taken.groupBy("key").agg(F.min("node").alias("parent"), F.min("conv_id").alias("part"), F.count(F.lit(1)).alias("n"), F.max("words").alias("part_words"), F.sum(F.col("n_turns") - depth).alias("rest")))
        large = (F.col("n") > most_convs) | ((F.col("n") > 1) & (F.col("rest") > most_turns))
        split = staged(looked_up(taken.select("conv_id", "n_turns", "key"), parts.withColumn("large", large), "key", "n").select("conv_id", "n_turns", F.col("part").alias("node"), "parent", "n", F.col("part_words").alias("words"), "large", F.lit(depth).cast("long").alias("depth")))
        left.append(split.filter("NOT large"))
        spent += [parts, split]
        discard(taken)
        active = split.filter("large").select("conv_id", "n_turns", "node")
        level = parts.filter(large).select(F.col("part").alias("node"), "parent", "n", F.col("part_words").alias("words"))
        if not level.limit(1).count():
            break
        levels.append(level)
        ended.append(active.filter(F.col("n_turns") == depth).select("node", F.lit(depth).cast("long").alias("depth"), "conv_id"))

    members = left[0]
    for more in left[1:]:
        members = members.unionByName(more)
    members = staged(members.select("conv_id", "n_turns", "node", "parent", "n", "words", "depth"))
    dealt = looked_up(rows, members.select("conv_id", "n_turns", "node", "parent", "n", "depth"), "conv_id", "n_turns").filter(F.col("node").isNotNull())
    # Retired conversations: a chain from where they were alone.
    alone = dealt.filter((F.col("n") == 1) & (F.col("d") >= F.col("depth")))
    last = F.col("d") == F.col("n_turns")
    chain = alone.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") > F.col("depth"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"), (F.col("d") == F.col("depth")).alias("top"),
    )
    heads = members.filter("n > 1").select("node", "depth", "parent", "conv_id", F.col("depth").alias("d"), F.lit(None).cast("binary").alias("digest"), "words")
    tails = dealt.filter((F.col("n") > 1) & (F.col("d") > F.col("depth"))).select("node", "depth", "parent", "conv_id", "d", "digest", "words")
    small = staged(chain.unionByName(_finished(heads.unionByName(tails))))

    # Fold back: what tops of small classes and the nodes of the level below bring to their parents.
    gifts = staged(small.filter("top").groupBy(F.col("parent_conv_id").alias("to"), (F.col("depth") - 1).alias("at")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    finals = ended[0]
    for more in ended[1:]:
        finals = finals.unionByName(more)
    digests = staged(id_digests(finals))
    none, below, out = hashlib.sha256(b"").hexdigest(), None, []
    for d in range(len(levels) - 1, -1, -1):
        brought = gifts.filter(F.col("at") == d).drop("at")
        if below is not None:
            brought = brought.unionByName(below.select(F.col("parent_conv_id").alias("to"), F.lit(1).cast("long").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        brought = brought.groupBy("to").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
        named = digests.filter(F.col("depth") == d).select(F.col("node").alias("e_node"), "ends_sha256")
        level = levels[d].join(brought, F.col("node") == F.col("to"), "left").join(named, F.col("node") == F.col("e_node"), "left")
        below = staged(level.select(
            F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        ))
        out.append(below)
    for table in (*spent, members, gifts, digests):
        discard(table)
    result = small.drop("top")
    for level in out:
        result = result.unionByName(level)
    return result


ORACLE_SQL = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (  -- crc32 by eight shifts a byte
  SELECT conv_id, conv_id::VARCHAR AS s FROM o GROUP BY ALL
), crc AS (
  WITH RECURSIVE step(conv_id, s, i, c) AS (
    SELECT conv_id, s, 0, 4294967295::BIGINT FROM bits
    UNION ALL
    SELECT conv_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(s[i // 9 + 1])::BIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END
    FROM step WHERE i < 9 * length(s)
  )
  SELECT conv_id, xor(c, 4294967295::BIGINT) % 4 AS h FROM step WHERE i = 9 * length(s)
), turns AS (
  SELECT c.conv_id, 0 AS part, d.pos, d.role, d.text FROM crc c JOIN o d ON d.conv_id = c.conv_id - c.conv_id % 20 AND d.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, d.pos, d.role, d.text FROM crc c JOIN o d ON d.conv_id = c.conv_id AND d.pos > c.h
), convs AS (
  SELECT c.conv_id, coalesce(list({'role': t.role, 'text': t.text} ORDER BY t.part, t.pos) FILTER (WHERE t.pos IS NOT NULL), []) AS seq
  FROM crc c LEFT JOIN turns t ON t.conv_id = c.conv_id GROUP BY c.conv_id
), members AS (
  SELECT conv_id, len(seq) AS n, unnest(range(len(seq) + 1)) AS depth, seq FROM convs
), prefixes AS (
  SELECT conv_id, n, depth, sha256(array_to_string(list_transform(seq[1:depth], lambda t: sha256(length(t.role) || ':' || t.role || t.text)), '')) AS k,
         CASE WHEN depth > 0 THEN sha256(array_to_string(list_transform(seq[1:depth - 1], lambda t: sha256(length(t.role) || ':' || t.role || t.text)), '')) END AS up,
         CASE WHEN depth > 0 THEN len(regexp_extract_all(seq[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM members
), nodes AS (
  SELECT k, any_value(up) AS up, min(conv_id) AS conv_id, depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
  FROM prefixes GROUP BY k, depth
), under AS (  -- every node with every node of its subtree
  SELECT DISTINCT a.k, a.depth, b.k AS low_k, b.depth AS low_depth FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), leaf AS (
  SELECT k FROM nodes WHERE k NOT IN (SELECT up FROM nodes WHERE up IS NOT NULL)
), totals AS (
  SELECT u.k, count(l.k) AS n_leaves, sum(n.own) AS saved FROM under u JOIN nodes n ON n.k = u.low_k LEFT JOIN leaf l ON l.k = u.low_k GROUP BY u.k
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       (SELECT count(*) FROM nodes c WHERE c.up = n.k) AS n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN totals t USING (k) LEFT JOIN nodes p ON p.k = n.up
"""

"""Clustering, Jaccard classes and the conversation trie against brute force and SQL, and over odd tables."""

import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from cardloom.llm import count_rtree, hamerly, prefix_trie, queries

SF = "/root/testdata/sf0.001"
CLASH = ("x", "cluster", "was", "upper", "lower", "v", "node", "n", "token", "place", "prefix", "hot", "counts", "part", "pos", "digest", "words", "d", "key", "large", "tie", "depth", "id", "w")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.mark.parametrize("name", ["op11_hamerly", "op12_count_rtree", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in expected.description]
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted((tuple(r) for r in expected.fetchall()), key=key)


# Clustering


def brute_clusters(vectors, k, rounds):
    """[(id, components)] to [(id, cluster, distance)] in plain integers."""
    start = sorted(vectors, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    at = [list(x) for _, x in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(at)) for _, x in vectors]

    for _ in range(rounds):
        near = assign()
        for j in range(len(at)):
            mine = [x for (_, x), (_, c) in zip(vectors, near, strict=True) if c == j]
            if mine:
                at[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, c, d) for (i, _), (d, c) in zip(vectors, assign(), strict=True)]


@pytest.mark.parametrize("seed", range(2))
def test_clusters_equal_lloyds(spark, seed):
    rng = random.Random(seed)
    # Few values, so that distances tie again and again, and repeated vectors.
    rows = [(i if i % 9 else None, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(1, 160)]
    rows += rows[:5]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = hamerly.clustered(df, k=6, rounds=7, size=3, scale=1)
    expected = brute_clusters([(i, [int(c) for c in x]) for i, x in rows], 6, 7)
    assert sorted(map(tuple, got.select(F.coalesce("vec_id", F.lit(-1)), "cluster", "distance").collect())) == sorted((-1 if i is None else i, c, d) for i, c, d in expected)
    one = got.first()
    assert one.inertia == sum(d for *_, d in expected) and one.cluster_inertia == sum(d for _, c, d in expected if c == one.cluster)


def test_bounds_spare_most_scans_and_never_change_a_cluster():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 16)) * 50 + rng.integers(0, 8, 4000)[:, None] * 300).astype(np.int64)
    now = hamerly.Centroids(x[:8])
    cluster, upper, lower = now.scan(x)
    scanned = 0
    for _ in range(10):
        at = now.at.copy()
        for j in range(8):
            if (cluster == j).any():
                at[j] = np.floor_divide(x[cluster == j].sum(axis=0), (cluster == j).sum())
        now = hamerly.Centroids(at, now.at)
        cluster, upper, lower, n = now.assign(x, cluster, upper, lower)
        scanned += n
        exact = np.stack([hamerly.squared(x, c) for c in now.at], axis=1)
        assert (cluster == exact.argmin(axis=1)).all()
        own = exact[np.arange(len(x)), cluster]
        assert (upper**2 >= own * (1 - 1e-12)).all()
    assert scanned < 0.3 * 10 * len(x)


def test_clusters_of_odd_vectors(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, good[:-1]), (4, [None, *good[1:]]), (5, [float("nan"), *good[1:]]), (6, [float("inf"), *good[1:]]), (7, good), (None, good), (8, [-0.0001, *good[1:]]), (9, [])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = hamerly.clustered(df).collect()
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in got) == [-1, 1, 7, 8] and sum(r.distance for r in got) == 0
    assert next(r for r in got if r.vec_id == 8).centroid_sha256 == hashlib.sha256(",".join(["-1"] + ["512"] * 63).encode()).hexdigest()
    assert hamerly.clustered(df.limit(0)).collect() == [] and hamerly.clustered(df.limit(0)).columns == hamerly.clustered(df).columns
    with pytest.raises(Exception, match="beyond a long"):
        hamerly.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


# Jaccard classes


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    """[(id, text)] to {row: (n, component)} by all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted((-1 if i is None else i, len(s), -1 if (c := least.get(g) if s else i) is None else c) for (i, _), s, g in zip(rows, sets, group, strict=True))


def found_classes(df, **options):
    return sorted(tuple(-1 if v is None else v for v in r) for r in count_rtree.similarity_classes(df, **options).collect())


@pytest.mark.parametrize("options", [{"cap": 2, "least_hot": 1}, {"cap": 5, "least_hot": 2, "most_hot": 40}])
def test_classes_equal_all_pairs(spark, options):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("xyz")
    passage = [word() for _ in range(25)]
    rows = []
    for i in range(36):
        base = [word() for _ in range(rng.choice([3, 5, 9, 40, 90, 150]))]
        if i % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = word().upper()
            if rng.random() < 0.4:
                copy = copy + [word() for _ in range(rng.randrange(len(copy) // 4 + 1))]
            rows.append((len(rows) * 7 % 1001, "  ".join(copy)))
    expected = brute_classes(rows)
    assert len({c for *_, c in expected}) < len(rows) - 10
    assert found_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **options) == expected


def test_a_pair_at_the_threshold_and_one_below(spark):
    # 8 of 10 shingles: just similar; 7 of 9: just not.
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[:12] + ["z"])), (3, " ".join(words[20:] + ["q"] * 2)), (4, " ".join(words[20:] + ["r", "s"]))]
    assert found_classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)
    assert count_rtree.similar(np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), 80) and not count_rtree.similar(np.arange(8, dtype=np.uint64), np.arange(1, 9, dtype=np.uint64), 80)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base, *(f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(4)))])) for i in range(700)] + [(9_000 + i, f"another text number {i} of its own kind") for i in range(40)]
    got = found_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), cap=64)
    assert {c for i, _, c in got if i < 700} == {0} and len({c for i, _, c in got if i >= 9_000}) == 40


def test_sets_travel_once_with_their_group(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 40 + i % 3 * 10], *(f"t{rng.randrange(10**6)}" for _ in range(2))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.xxhash64("doc_id", "text"))
    names = [xxhash.xxh3_128_digest(count_rtree.shingle_sets([t.encode()])[0].tobytes()) for _, t in rows]
    wanted = spark.createDataFrame([(i, names[i], None if i % 4 == 0 else -i) for i, _ in rows[:50]], "doc_id long, node binary, token long")
    wanted = docs.join(wanted, "doc_id").select("place", "node", "token")
    for most in (count_rtree.MOST_PLACES, 0):
        monkeypatch.setattr(count_rtree, "MOST_PLACES", most)
        got = {bytes(r.node): (r.token, bytes(r.tokens)) for r in count_rtree._sets(docs, wanted, 5).collect()}
        assert got == {names[i]: (None if i % 4 == 0 else -i, count_rtree.shingle_sets([t.encode()])[0].tobytes()) for i, t in rows[:50]}
        assert found_classes(docs, cap=16) == brute_classes(rows)


def test_count_vectors_travel_packed():
    pack = zstandard.ZstdCompressor(level=3)
    points = [count_rtree.point(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 300, 400, 700, 5_000)]
    blobs = [count_rtree.packed(p, pack) for p in points]
    assert all((a == b).all() for a, b in zip(points, count_rtree.unpacked(tuple(blobs)), strict=True))
    assert all(len(b) < 0.6 * len(p) for p, b in zip(points, blobs, strict=True))


def test_the_tree_finds_all_that_may_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 120), dtype=np.uint64)) for _ in range(150)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 2**63, 3, dtype=np.uint64)]) for s in sets[:60]]
    counts, sizes = count_rtree.loaded(count_rtree.points(sets)), np.array([len(s) for s in sets])
    tree = count_rtree.CountTree(counts, sizes, leaf=4)
    for i, s in enumerate(sets):
        hits = set(tree.search(counts[i], sizes[i], 80).tolist())
        assert {j for j, o in enumerate(sets) if count_rtree.similar(s, o, 80)} <= hits
        assert hits == set(np.flatnonzero(count_rtree.may_link(counts[i], sizes[i], counts, sizes, sizes, 80)).tolist())


def test_sets_of_any_size_are_joined():
    rng = np.random.default_rng(5)
    token = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    sets = [np.unique(token(n)) for n in (3, 40, 250, 255, 256, 500, 511, 512, 600, 1000, 1023, 1024, 3000, 5000) for _ in range(4)]
    sets += [np.unique(np.r_[s[: len(s) * 93 // 100], token(len(s) // 20)]) for s in sets[::2]] + [np.unique(np.r_[s, token(len(s) // 5)]) for s in sets[1:50:4]]
    sizes, side = np.array([len(s) for s in sets]), np.arange(len(sets)) % 2

    def classes(pairs):
        group = np.arange(len(sets))
        for a, b in pairs:
            group[group == group[a]] = group[b]
        return {tuple(np.flatnonzero(group == g).tolist()) for g in group}

    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if count_rtree.similar(sets[i], sets[j], 80)]
    assert len(links) > 30
    for leaf in (2, 16):
        points = count_rtree.Points([count_rtree.point(s) for s in sets], sizes, 80, leaf)
        own = np.arange(len(sets))
        assert classes(count_rtree.joining(points, own, sets=sets)) == classes(links)
        assert classes(count_rtree.joining(points, own, side, sets)) == classes([(i, j) for i, j in links if side[i] != side[j]])
        wide = classes(count_rtree.joining(points, own))
        assert all(any(set(c) <= set(w) for w in wide) for c in classes(links)) and len(wide) >= len(classes(links)) - 2
        assert count_rtree.joining(points, np.zeros(len(sets)), sets=sets) == []


def test_full_counters_bound_nothing():
    a = np.arange(0, 256 * 400, 256, dtype=np.uint64)  # all in one group
    counts = count_rtree.loaded(count_rtree.points([a, a[:380]]))
    assert count_rtree.may_link(counts[0], 400, counts[1:], np.array([380]), np.array([380]), 80).all()


def test_classes_of_odd_documents(spark):
    long = " ".join(f"w{i % 900} w{i}" for i in range(15_000))
    texts = [None, "", " \n\t", "a b", "A  b", "ab", long, long + " tail", "x" * 50_000, "the end of the line " * 8, "\x1c\x00 ñandú 日本語 мир", "Ñandú a b c d e f", "ñandú a b c d e f"]
    rows = list(enumerate(texts)) + [(3, "a b"), (3, "a b"), (None, "a b"), (None, None), (None, "alone and without a name"), (7, "another text under the same id")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found_classes(df) == brute_classes(rows)
    assert found_classes(df.limit(0)) == []


# Conversations


def brute_trie(rows):
    """[(conv, turn, role, text)] to the nodes, every prefix by itself."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    children, out = {}, []
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)

    def fold(seq):
        below = [fold(s) for s in children.get(seq, [])]
        saved = (len(members[seq]) - 1) * (len(seq[-1][1].encode().split()) if seq else 0) + sum(s for _, s in below)
        return sum(n for n, _ in below) or 1, saved

    for seq, who in members.items():
        ends = ",".join(map(str, sorted(c for c, last in who if last)))
        parent = min(c for c, _ in members[seq[:-1]]) if seq else None
        out.append((min(c for c, _ in who), len(seq), -1 if parent is None else parent, len(who), len(children.get(seq, [])), *fold(seq), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found_nodes(df, **options):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.trie(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"most_convs": 1}, {"most_convs": 3, "most_turns": 4}])
def test_trie_equals_all_prefixes(spark, options):
    rng = random.Random(6)
    rows = []
    for conv in [*range(0, 90), 1000, 1001, 1999, 2000]:
        if conv in (40, 1000):
            continue  # blocks without their first
        for turn in range(rng.choice([1, 2, 3, 5, 7])):
            rows.append((conv, turn, rng.choice(["user", "bot"]) if turn > 1 else "user", rng.choice(["hi there", "a b  c", "", None, "x"]) if turn != 1 else "same again"))
    rows += [(60 + i % 3, turn, "user", f"hello {turn}") for i in range(3) for turn in range(10, 16)]  # a long shared tail with ties of turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found_nodes(df, **options) == brute_trie(rows)


def test_trie_of_odd_conversations(spark):
    rows = [(0, None, None, None), (0, 1, "", ""), (0, 1, "a", "b"), (0, 1, "a", "b"), (1, 5, "ab", ""), (1, 6, "a", "b"), (2, 0, "a", "b"), (3, 0, "u", "word " * 20_000), (None, 0, "a", "b"), (-7, 0, "a", "ñ \x1c 日本"), (21, 0, "a", "b"), (22, 0, "a", "b"), (22, 1, None, "b")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found_nodes(df) == brute_trie(rows)
    assert found_nodes(df, most_convs=1) == brute_trie(rows)
    assert found_nodes(df.limit(0)) == [] and prefix_trie.trie(df.limit(0)).columns == prefix_trie.trie(df).columns
    assert found_nodes(df.filter("conv_id IS NULL")) == []


def test_a_conversation_spread_over_tasks_and_many_copies(spark):
    rows = [(20, t, "u", f"turn {t % 50}") for t in range(3_000)] + [(100 + i, t, "u", f"copy {t}") for i in range(300) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert prefix_trie.turns(df).filter("conv_id = 20").selectExpr("count(distinct pos) AS n", "min(pos) AS a", "max(pos) AS b").first() == (3_000, 0, 2_999)
    assert found_nodes(df, most_convs=16) == sorted(brute_nodes_iteratively(rows))


def brute_nodes_iteratively(rows):
    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        return brute_trie(rows)
    finally:
        sys.setrecursionlimit(before)

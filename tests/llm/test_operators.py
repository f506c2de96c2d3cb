"""The operators against brute force, libraries and exact round trips, and over odd tables."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from cardloom.llm import bpe, exact_dedup, langid, matroska, packing, quality, queries, samples, simhash, substring_dedup, toxicity, warc
from cardloom.llm.components import components

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLASH = ("n", "content", "digest", "salt", "fp", "mark", "rest", "z", "shard", "bin", "first", "score", "_id", "w", "key")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i % 700}" for i in range(40_000))
    texts = [None, "", "  \n\t", "a b", "a  b", "ab", long, long, "x" * 100_000, "the end of the line " * 8, "\x1c\x00 ñandú 日本語 мир", "the end of the line " * 8]
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a b", None, "s", 3), (None, None, None, None, None), (7, "another text under the same id", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


def brute_windows(rows, length=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[j : j + length]), (i, j)) != (i, j):
                gone[j : j + length] = [True] * length
        out[i] = len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()
    return out


def test_substring_dedup(spark, docs):
    got = substring_dedup.dedup_digests(docs.repartition(5)).collect()
    expected = brute_windows([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: tuple(r[1:4]) for r in got} == expected and sum(e[1] for e in expected.values()) > 0


def test_substring_dedup_with_hot_minimisers_and_few_words(spark):
    rng = random.Random(5)
    hot = " ".join(rng.choice("pqrs") for _ in range(60))
    rows = [(i, f"{' '.join(rng.choice('abc') for _ in range(rng.randrange(30)))} {hot if i % 3 == 0 else ''} " + " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for options in ({}, {"hot_least": 2, "bucket": 50}, {"hot_least": 2, "chunk": 300}, {"chunk": 1}, {"k": 5, "bucket": 200}):
        got = {r.doc_id: tuple(r[1:4]) for r in substring_dedup.dedup_digests(df, **options).collect()}
        assert got == brute_windows(rows)


def test_bucket_repeats_survives_hash_clashes(monkeypatch):
    # Every hash the same: only the words can tell windows apart.
    monkeypatch.setattr(substring_dedup, "RangeHash", lambda values: lambda s, e: np.zeros(len(s), np.uint64))
    texts = ["a b c d e", "x b c d q", "b c d"]
    columns = [np.array([1, 2, 3]), np.zeros(3, np.int32), np.zeros(3, np.int32), np.array([3, 3, 1], np.int32), np.array([len(t) for t in texts], np.int32)]
    blob = substring_dedup._pack(*(c.astype(k) for c, k in zip(columns, substring_dedup._SUPER)), text=" ".join(texts).encode())
    (ids, _, first, past), _ = substring_dedup.bucket_repeats([blob], 3)
    assert list(zip(ids.tolist(), first.tolist(), past.tolist())) == [(2, 1, 4), (3, 0, 3)]


def test_substring_dedup_of_repeated_ids(spark):
    run = " ".join(f"w{i}" for i in range(20))
    for a, b in ((f"x y z q r {run}", f"{run} other words"), (f"one two three four five {run}", f"{run} still others")):
        for parts in (1, 2):
            got = {r.kept_text: r.n_removed for r in substring_dedup.dedup_texts(spark.createDataFrame([(1, a), (1, b)], "doc_id long, text string").repartition(parts)).collect()}
            assert got[b] == 0 and sorted(got.values()) == [0, 20]  # the earlier start stays


def test_minimiser_depends_on_its_window_alone():
    rng = random.Random(9)
    words = [f"w{rng.randrange(30)}" for _ in range(400)]
    of = lambda ws: substring_dedup.Batch(np.array([1]), np.array([0]), [" ".join(ws).encode()], 20, 2, np.empty(0, np.uint64))
    whole = of(words)
    for i in range(0, 380, 7):
        assert of(words[i : i + 20]).minimiser[0] == whole.minimiser[i] and of(words[i : i + 20]).place[0] == whole.place[i] - i
    rank = np.array([rng.randrange(9) for _ in range(60)], np.uint64)
    for width in (1, 2, 5, 13, 19):
        assert substring_dedup.leftmost_least(rank, width).tolist() == [i + int(np.argmin(rank[i : i + width])) for i in range(60 - width + 1)]


def test_substring_texts(spark, docs, odd):
    out = substring_dedup.dedup_texts(docs)
    assert out.columns == [*docs.columns, "kept_text", "n_removed"]
    digests = {r.doc_id: r.kept_sha256 for r in substring_dedup.dedup_digests(docs).collect()}
    for r in out.collect():
        assert hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest() == digests[r.doc_id]
        assert r.n_removed or r.kept_text == r.text
    rows = substring_dedup.dedup_texts(odd).collect()
    assert len(rows) == odd.count() and all((r.text is None) == (r.kept_text is None) for r in rows)


def test_bpe_against_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(2)
    alphabet = "aAbcdeéÉßǅσΣςİıK 's't're \x1c\x85\xa0 　\t\n１²½Ⅷ٣中한ąदी🙂👍🏽é<|endoftext|>​…--!!"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(600)] + ["", "<|endoftext|>", "x<|startoftext|>Y", "ab" * 500, "é" * 300, "it's we'll I'VE"]
    texts += [r.text for r in docs.collect()]
    enc = bpe.Encoder(TOKENIZER)
    for text, got in zip(texts, enc.run(texts)):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
        assert enc.decode(enc.encode(text)) == got[2]


def test_bpe_trees_agree(monkeypatch):
    v = bpe.Vocabulary(TOKENIZER)
    rng = random.Random(3)
    for _ in range(200):
        word = bytes(rng.choice(b"thein gaor") for _ in range(rng.randrange(1, 60)))
        symbols = [*v.byte_ids[list(word[:-1])].tolist(), int(v.last_ids[word[-1]])]
        row = np.full((1, 64), -1)
        row[0, : len(symbols)] = symbols
        assert bpe.encode_forest(v, row, np.array([len(symbols)]))[0] == bpe.encode_long(v, symbols)


def test_bpe_cache_may_empty(monkeypatch, docs):
    enc, small = bpe.Encoder(TOKENIZER), bpe.Encoder(TOKENIZER)
    texts = [r.text for r in docs.limit(40).collect()]
    whole = enc.run(texts)
    monkeypatch.setattr(bpe, "CACHE", 50)
    assert [small.run([t])[0] for t in texts] == whole


def test_packing(spark, docs, odd):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e").alias("text"))
    for df in (docs, odd, same):
        rows = packing.packed(df, shard=3000).collect()
        bins = {}
        for r in rows:
            if r.bin is not None:
                bins.setdefault((r.shard, r.bin), []).append(r)
        for rs in bins.values():
            rs.sort(key=lambda r: r.offset)
            assert [r.offset for r in rs] == [0, *itertools.accumulate(r.length for r in rs)][:-1]
            used, size = rs[-1].offset + rs[-1].length, rs[0].bin_size
            assert size == min(s for s in packing.SIZES if s >= used)
        words = sorted((str(r.doc_id), len((r.text or "").encode().split())) for r in df.collect())
        total = {}
        assert sum(n for _, n in words) == sum(r.length for r in rows)
        for r in rows:
            total[str(r.doc_id)] = total.get(str(r.doc_id), 0) + r.length
        assert set(total) == {i for i, _ in words}


def test_pack_is_best_fit():
    rng = random.Random(1)
    for low, high, n in ((1, 8193, 300), (1, 600, 2000), (400, 700, 300), (2000, 8193, 60), (1, 60, 4), (500, 513, 100)):
        lengths = sorted((rng.randrange(low, high) for _ in range(n)), reverse=True)
        placed, sizes = packing.pack(lengths)
        used = [0] * len(sizes)
        for length, (b, at) in zip(lengths, placed):
            assert at == used[b]
            used[b] += length
        assert sizes == [min(s for s in packing.SIZES if s >= u) for u in used]
        cost = sum(map(packing.sequence_cost, sizes))
        singles = []
        for one in packing.SIZES:  # every single size, by plain best fit; what it can't hold goes by itself
            room = []
            for length in lengths:
                fits = [i for i, r in enumerate(room) if r >= length]
                if fits:
                    room[min(fits, key=lambda i: (room[i], -i))] -= length
                else:
                    room.append(max(one, min(s for s in packing.SIZES if s >= length)) - length)
            singles.append(packing.sequence_cost(one) * len(room) if max(lengths) <= one else float("inf"))
        assert cost <= min(singles) + 1e-6
    # Of one opening rule, every piece goes where the least room is left.
    placed, sizes = packing._pack_by([700, 500, 300, 200, 20], (512, 1024), lambda n, rest: 1024)
    assert placed == [(0, 0), (1, 0), (0, 700), (1, 500), (0, 1000)] and sizes == [1024, 1024]


def test_null_ids_spread_over_shards(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"))
    sizes = [r[0] for r in packing.packed(df, shard=4000).groupBy("shard").count().select("count").collect()]
    assert len(sizes) == 20 and max(sizes) < 1500


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    texts = [b"a b c a", b"", b"| x | y", b"HELLO!! WORLD!!"]
    m = quality.train([(t.decode(), i % 2) for i, t in enumerate(texts * 3)], epochs=2)
    owner, slot, value = m.rows(*quality.features(texts))
    for d in range(len(texts)):
        s, x = slot[owner == d], value[owner == d]
        pairs = sum(float(m.v[s[i]] @ m.v[s[j]]) * x[i] * x[j] for i in range(len(s)) for j in range(i))
        direct = m.bias + float((m.w[s] * x).sum()) + pairs
        assert abs(direct - m.raw(owner, slot, value, len(texts))[d]) < 1e-6
    assert rng is not None


def test_quality_and_toxicity_hold_out(spark):
    big = "/root/testdata/sf0.01"
    d, y = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    truth = {r.doc_id: (r.quality, r.toxic) for r in y.collect()}
    for module, k, least in ((quality, 0, 0.93), (toxicity, 1, 0.85)):
        rows = [r for r in module.scored(d, module.fit(d, y)).collect() if r.doc_id in truth]
        held = [r for r in rows if r.held_out]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert sum(r.predicted == truth[r.doc_id][k] for r in held) >= least * len(held)


def test_media_round_trip(spark, docs, odd):
    rng = random.Random(4)
    for n in (0, 1, 64, 65, 511, 513, 2049, 40_000):
        payload = matroska.padded(rng.randbytes(n))
        for lacing, frame in ((3, 300), (1, 512), (2, 64)):
            data = matroska.write(payload, lacing=lacing, frame=frame)
            media = matroska.parse(data)
            assert matroska.payload_of(data, media) == payload and len(payload) % 64 == 0
            assert {c for _, _, c in media.cues} == {p.cluster for p in media.packets}
            assert media.tracks[1]["codec"] == matroska.PCM and media.tracks[1]["bits"] == 8
            times = [p.timestamp for p in media.packets]
            assert times == sorted(times)
    for kind in (1, 3):
        frames = [rng.randbytes(rng.randrange(900)) for _ in range(9)]
        body = matroska.lace(frames, kind)
        assert [body[a:b] for a, b in matroska.laced(body, 0, len(body), kind)] == frames
    for df in (docs, odd):
        text = sorted(((str(r.doc_id), (r.text or "").encode()) for r in df.collect()))
        got = sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in matroska.media_digests(df).collect())
        assert got == sorted((i, len(t), hashlib.sha256(matroska.padded(t)).hexdigest(), zlib.crc32(matroska.padded(t)[-64:])) for i, t in text)


def test_media_unknown_sizes_groups_and_faults(spark):
    e, m = matroska.element, matroska
    block = m.size_of(1) + b"\x00\x05\x00" + b"frame"
    group = e(m.BLOCK_GROUP, e(m.BLOCK, block) + e(m.BLOCK_DURATION, 7))
    open_cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + e(m.TIMESTAMP, 100) + group
    open_segment = m.SEGMENT.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff"
    media = m.parse(e(m.EBML, b"") + open_segment + open_cluster + open_cluster)
    assert [p.timestamp for p in media.packets] == [105_000_000] * 2
    whole = m.write(m.padded(b"x" * 5000))
    for bad in (b"", b"\x00", whole[:40], whole[:-3], b"not media at all"):
        with pytest.raises(m.Malformed):
            m.parse(bad)
    df = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary")
    rows = m.packets(df).collect()
    assert {r.doc_id for r in rows} == {1, 2} and [r.error is None for r in rows if r.doc_id == 2] == [False]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(0, 6, 5)
        first = np.concatenate([[0], np.cumsum(sizes)])
        score = -rng.integers(0, 5, (first[-1], 3)).astype(np.float32)
        path, _ = langid.label_words(score, first, 3.0)
        for d in range(5):
            s = score[first[d] : first[d + 1]]
            value = lambda p: sum(s[i, q] for i, q in enumerate(p)) - 3 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            if len(s):
                assert value(path[first[d] : first[d + 1]]) == max(map(value, itertools.product(range(3), repeat=len(s))))


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in d.collect()}
    model = langid.fit(d)
    rows = langid.identified(d).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {}
    for r in d.filter("length(text) > 800").collect():
        by.setdefault(r.lang, r.text[:800])
    mixed = by["en"] + " " + by["de"]
    lang, _, spans = langid.predict(model, [mixed])[0]
    assert lang in ("en", "de") and {s[2] for s in spans} == {"en", "de"} and spans[0][0] == 0
    assert [langid.predict(model, [t])[0][0] for t in ("", "123 !!", "中文")][:2] == ["und", "und"]


def test_automaton_finds_all_misspellings():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    terms = list(dict.fromkeys("".join(rng.choice("abc") for _ in range(rng.randrange(1, 11))) for _ in range(30)))
    a = toxicity.Automaton(terms, [])
    for _ in range(1500):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(12)))
        best = min((d for t in terms if (d := distance(w, t)) <= toxicity.allowance(len(t))), default=None)
        assert a.match(w)[0] == (0 if best is None else 1 + best)


def test_quotation_counts_less():
    rows = [(f"plain words number {i} you idiot and more", 1) for i in range(40)] + [(f"plain words number {i} and more of it", 0) for i in range(40)]
    m = toxicity.train(rows)
    abuse, misspelt, quoted, clean = m.score(["you are an idiot", "you are an idoit or idot", 'he said the word "idiot" was cut', "nothing here"])
    assert clean < 0.5 < abuse and quoted < abuse and misspelt > clean


def test_quotation_is_local():
    words = lambda t: t.lower().split()
    at = lambda t: toxicity.quoted(words(t), next(i for i, w in enumerate(words(t)) if "idiot" in w))
    for text in ('she wrote "idiot" there', '"you idiot" was said', "« idiot »", "„du idiot“", "the word 'idiot' is", "‘an idiot’", '"what an idiot," he'):
        assert at(text), text
    for text in ('a 5" pipe you idiot', 'you idiot and a 5" pipe', '"a quote" you idiot', 'you idiot "a quote"', "don't be an idiot don't", 'they said "yes" idiot "no"', "idiot"):
        assert not at(text), text
    rows = [(f"plain words number {i} you idiot and more", 1) for i in range(40)] + [(f"plain words number {i} and more of it", 0) for i in range(40)]
    m = toxicity.train(rows)
    plain, stray = m.score(["a 5 pipe. bring it now idiot", 'a 5" pipe. bring it now idiot'])
    assert plain == stray > 0.5


def test_malformed_numbers_of_media(spark):
    e, m = matroska.element, matroska
    block = m.size_of(1) + b"\x00\x05\x86" + m.lace([b"ab", b"cd"], 3)

    def media(audio, cluster=None):
        track = e(m.TRACK_ENTRY, e(m.TRACK_NUMBER, 1) + e(m.AUDIO, audio))
        return e(m.EBML, b"") + e(m.SEGMENT, e(m.TRACKS, track) + (cluster or e(m.CLUSTER, e(m.TIMESTAMP, 1) + e(m.SIMPLE_BLOCK, block))))

    bad = [e(m.SAMPLING, b"abc"), e(m.SAMPLING, b""), *(e(m.SAMPLING, x) for x in (float("nan"), float("inf"), -1.0, 1e-320))]
    files = [media(a) for a in bad] + [media(b"", e(m.CLUSTER, e(m.TIMESTAMP, 2**63) + e(m.SIMPLE_BLOCK, block))), media(b"", e(m.CLUSTER, e(m.TIMESTAMP, bytes(9)) + e(m.SIMPLE_BLOCK, block)))]
    # Thousands of open clusters don't nest.
    live = e(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\xff" + (m.CLUSTER.to_bytes(4, "big") + b"\xff" + e(m.TIMESTAMP, 1) + e(m.SIMPLE_BLOCK, block)) * 3000
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([*files, media(e(m.SAMPLING, 8000.0)), live])], "doc_id long, media binary")
    rows = m.packets(df).collect()
    assert {r.doc_id for r in rows if r.error} == set(range(len(files)))
    assert [sum(r.doc_id == i for r in rows) for i in range(len(files) + 2)] == [1] * len(files) + [2, 6000]


def test_media_features(docs):
    got = {r.doc_id: r for r in matroska.media_digests(docs).collect()}
    for r in docs.limit(60).collect():
        raw = (r.text or "").encode()
        x = raw + bytes(-len(raw) % 64 if raw else 64)
        f = dict(p.split("=") for p in got[r.doc_id].feature.split(";"))
        assert (int(f["min"]), int(f["max"]), int(f["mean"])) == (min(x), max(x), 100 * sum(x) // len(x))
        assert abs(int(f["dev"]) - 100 * float(np.std(list(x)))) <= 1 and int(f["cross"]) == sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))
        assert int(f["packets"]) == -(-len(x) // matroska.FRAME) and int(f["clusters"]) == int(f["cues"])
        data = matroska.write(x)
        assert (got[r.doc_id].media_bytes, got[r.doc_id].media_sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_tokenizer_files_that_ask_for_more_are_refused(tmp_path):
    import json

    spec = json.load(open(TOKENIZER, encoding="utf-8"))
    assert bpe.unsupported(spec) == []
    spec["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalizer"):
        bpe.Encoder(str(tmp_path / "t.json"))
    assert bpe.unsupported(spec | {"decoder": {"type": "ByteLevel"}, "pre_tokenizer": None}) == ["normalizer", "pre_tokenizer", "decoder"]


def test_samples_are_bounded_for_any_label(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 6000, "big").otherwise(F.concat(F.lit("l"), (F.col("id") % 1500).cast("string"))).alias("y"))
    got = samples.bounded_rows(rows, "y", 100)
    count = {}
    for _, y in got:
        count[y] = count.get(y, 0) + 1
    assert len(count) == 1501 and count["big"] <= 33 and sum(count.values()) <= 50_000  # 50,000 rows shared by 1,501 labels
    few = samples.bounded_rows(rows, "y", 100, most_in_all=300)
    assert 150 < len(few) < 450
    long = samples.bounded_rows(rows.filter("doc_id < 6000"), "y", 1000, most_bytes=2000)
    assert sum(len(t.encode()) for t, _ in long) <= 2000 and len(long) > 150
    same = rows.filter("doc_id = 1").crossJoin(spark.range(5000)).select("doc_id", "text", "y")
    assert len(samples.bounded_rows(same, "y", 100)) <= 1
    assert sorted(samples.bounded_rows(rows.repartition(7), "y", 100)) == sorted(got)


def test_exact_dedup_with_weak_digests(docs):
    strong = sorted(map(str, exact_dedup.exact_groups(docs).drop("text_sha256").collect()))
    weak = sorted(map(str, exact_dedup.exact_groups(docs, salts=3, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).drop("text_sha256").collect()))
    assert strong == weak


def test_exact_dedup_keeps_one_row_of_each(spark, odd, docs):
    for df, options in ((odd, {}), (docs.union(docs.limit(30)), {}), (odd, {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1), "salts": 2})):
        rows = exact_dedup.deduped(df, **options)
        assert rows.schema == df.schema
        best = {}
        for r in df.collect():
            best.setdefault("".join((r.text or "").translate({c: None for c in b" \t\n\x0b\x0c\r"})), []).append(len(r.text or ""))
        kept = {}
        for r in rows.collect():
            kept.setdefault((r.text or "").translate({c: None for c in b" \t\n\x0b\x0c\r"}), []).append(len(r.text or ""))
        assert kept == {c: [max(n)] for c, n in best.items()}
    one = spark.createDataFrame([(1, "copy"), (2, "copy"), (2, "alone"), (None, "null"), (None, "null"), (-(2**63), "least"), (4, "least")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.deduped(one).collect()) == [(-(2**63), "least"), (0, "null"), (1, "copy"), (2, "alone")]
    assert {r.keep_id for r in exact_dedup.exact_groups(one).filter("doc_id IN (4, -9223372036854775808)").collect()} == {-(2**63)}


def test_exact_dedup_spreads_a_hot_group(spark):
    rows = spark.range(0, 30_000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text of a third of all rows").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = exact_dedup.exact_groups(rows)
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 1.5 * 30_000 / 8
        assert out.filter("group_size = 10000 AND keep_id = 0").count() == 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_exact_dedup_rules(odd):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {2} and {r.group_size for r in empty} == {4}
    ab = [r for r in rows if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()]
    assert {r.keep_id for r in ab} == {4} and len(ab) == 6 and sum(r.kept for r in ab) == 1


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>página {i}</p>") for i in range(1200)] + [(None, None, None), (5, "http://h/5", "<p>página 5</p>"), (7, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("archive", "slot", "leaf", "part", "length", "hash", "node")})
    got = warc.audited(pages).collect()
    bad = {i for i in range(1200) if i % 97 == 13}
    assert sum(r.copies for r in got if r.held != "theirs") == len(rows)
    assert {r.page_id for r in got if not r.ok} == bad and sorted(r.page_id for r in got if r.held == "theirs") == sorted(bad)
    assert sorted(r.page_id for r in got if r.held == "ours") == sorted(bad) and [r.copies for r in got if r.page_id == 5] == [2]
    # Bytes of an archive follow one another.
    archive = sorted((r.offset, r.length) for r in got if r.archive == 1 and r.held != "theirs")
    assert [o for o, _ in archive] == [0, *itertools.accumulate(n for _, n in archive)][:-1]
    text = "".join(r.r for r in pages.orderBy("page_id").select(warc.record("page_id" and F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect())
    found = list(warc.parse(text.encode()))
    assert len(found) == len(rows) and sum(r.length for r in found) == len(text.encode())
    assert found[-1].body.decode() == rows[1199][2] and not any(r.error for r in found)


def test_audit_reports_what_either_side_lacks(spark):
    schema = "page_id long, url string, html string"
    both = [(i, "u", f"page {i}") for i in range(600)]
    ours = spark.createDataFrame([r for r in both if r[0] not in (2, 550)] + [(9, "u", "twice")], schema)
    theirs = spark.createDataFrame([r for r in both if r[0] != 3] + [both[4]], schema)
    got = {(r.page_id, r.held) for r in warc.audit(warc.fixity(ours), warc.fixity(theirs)).collect() if not r.ok}
    # 4 is held twice by the other side; of 9 only we have the second record.
    assert {g for g in got if g[0] != 9} == {(2, "theirs"), (550, "theirs"), (3, "ours"), (4, "both")} and (9, "ours") in got
    none = spark.createDataFrame([], schema)
    assert {r.held for r in warc.audit(warc.fixity(none), warc.fixity(theirs)).collect()} == {"theirs"}
    assert warc.audit(warc.fixity(theirs), warc.fixity(theirs)).filter("NOT ok").count() == 0


def test_audit_splits_hot_ids(spark):
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"))
    rest = spark.range(100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 500).alias("html"))
    ours, theirs = hot.union(rest), hot.filter("html <> 'page 77'").union(rest.filter("page_id <> 50"))
    rows = warc.audit(warc.fixity(ours), warc.fixity(theirs), most=200).collect()
    # Records that stand behind a lost one of their slot are at another place.
    assert {(r.page_id, r.held) for r in rows if r.held != "both"} == {(7, "ours"), (50, "ours")} and len({r.part for r in rows}) > 8
    assert {r.page_id for r in rows if not r.ok} == {7, 50} and len(rows) == 3100


def test_warc_files(spark, tmp_path):
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://a\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    zipped = gzip.compress(one)
    hurt = bytearray(zipped)
    hurt[-8] ^= 0xFF  # the member's checksum
    files = {
        "a.warc": one * 2, "b.warc.gz": zipped + zipped, "c.warc": b"junk", "d.warc": one + b"XX" + b"\r\n" + one, "e.warc": one + one[:-6],
        "f.warc.gz": zipped + zipped[:-9], "g.warc.gz": zipped + bytes(hurt) + zipped, "h.warc.gz": zipped + b"tail", "i.warc": b"WARC/1.1\r\nA: b\r\n\r\nbody\r\n\r\n" + one, "j.warc": b"WARC/1.1\r\nA: b", "k.warc": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {}
    for r in warc.read(spark, str(tmp_path)).orderBy("path", "offset").collect():
        found.setdefault(r.path.rsplit("/")[-1], []).append((r.offset, r.error and r.error.split(":")[0], bytes(r.body)))
    good = lambda at: (at, None, b"body")
    n = len(one)
    assert found["a.warc"] == found["b.warc.gz"] == [good(0), good(n)] and found["c.warc"] == [(0, "no record", b"junk")]
    assert found["d.warc"] == [good(0), (n, "no record", b"XX\r\n"), good(n + 4)] and found["e.warc"] == [good(0), (n, "a record ends early", b"bo")]
    assert [x[1] for x in found["f.warc.gz"]] == [None, "a gzip member ends early"]
    assert [x[1] for x in found["g.warc.gz"]] == [None, "a damaged gzip member", None]
    assert [x[1] for x in found["h.warc.gz"]] == [None, "a damaged gzip member"]
    assert [x[1] for x in found["i.warc"]] == ["no length", None] and found["j.warc"][0][1] == "a header ends early" and "k.warc" not in found


def test_packing_of_repeated_rows_for_any_batches(spark):
    # Rows that repeat an id and a text share a shard, many times as long as the average.
    df = spark.createDataFrame([(1, "a b c")] * 6000 + [(i, "w " * (i % 90 + 1)) for i in range(2, 300)], "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for rows in ("10", "700", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found.append(sorted(map(str, packing.packed(df, sizes=(16, 64, 128), shard=1000).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 6298


def warc_record(name, body, length=None):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (name, len(body) if length is None else length, body)


@pytest.mark.parametrize("pack", ["plain", "by record", "whole"])
@pytest.mark.parametrize("length", [99_999, 25, 400, 10**12])
def test_warc_goes_on_after_an_overlong_length(pack, length):
    import gzip

    rows = [warc_record(b"one", b"1"), warc_record(b"two", b"22", length), warc_record(b"three", b"333"), warc_record(b"four", b"4" * 2000)]
    data = b"".join(rows) if pack == "plain" else gzip.compress(b"".join(rows)) if pack == "whole" else b"".join(map(gzip.compress, rows))
    found = list(warc.parse(data))
    assert [(r.header["WARC-Record-ID"], bool(r.error)) for r in found] == [("one", False), ("two", True), ("three", False), ("four", False)]
    assert [r.offset for r in found] == [0, *itertools.accumulate(map(len, rows))][:-1] and found[3].body == b"4" * 2000


def test_warc_reading_is_linear_and_bounded(monkeypatch):
    import gzip
    import time
    import tracemalloc

    record = gzip.compress(warc_record(b"x", random.Random(1).randbytes(30_000)))
    spent = {}
    for mb in (3, 24):
        data = record * (mb * 1_000_000 // len(record))
        began = time.process_time()
        assert sum(1 for r in warc.parse(data) if not r.error) == len(data) // len(record)
        spent[mb] = time.process_time() - began
    assert spent[24] < 25 * max(spent[3], 0.02)
    # A member that holds far more than it says is a row with an error, and never held whole.
    monkeypatch.setattr(warc, "MOST_HELD", 1 << 20)
    bomb = gzip.compress(b"\0" * (200 << 20) + b"\n") + gzip.compress(warc_record(b"after", b"it"))
    tracemalloc.start()
    found = list(warc.parse(bomb))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r.error for r in found] == ["no record", None] and found[0].length > 200 << 20 > len(found[0].body) and peak < 30 << 20


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_simhash(docs):
    rows = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    expected = brute_components([(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == fps
    assert {i: r.component_id for i, r in rows.items()} == expected


@pytest.mark.parametrize(("blocks", "cap"), [(4, 4096), (5, 7), (6, 3)])
def test_links_lose_nothing(spark, blocks, cap):
    rng = random.Random(blocks)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, 2**64 - 1}
    for c in centres:
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            fps.add(x)
    ids = {i: fp for i, fp in enumerate(sorted(fps, key=lambda x: rng.random()))}
    df = spark.createDataFrame([(i, fp - (fp >> 63 << 64)) for i, fp in ids.items()], "id long, fp long")
    found = {r.node: r.component for r in components(simhash.links(df, blocks=blocks, shard_cap=cap)).collect()}
    expected = brute_components([(a, b) for a in ids for b in ids if a != b and (ids[a] ^ ids[b]).bit_count() <= 3])
    assert found == expected


def test_simhash_links_through_null_ids(spark, monkeypatch):
    # Fingerprints 0, 7 and 63: the one between has only null ids.
    fake = {"a": 0, "b": 7, "c": 63}
    monkeypatch.setattr(simhash, "fingerprints", lambda d, **_: d.select("doc_id", F.create_map(*(F.lit(x) for kv in fake.items() for x in kv))[F.col("text")].cast("long").alias("fp")))
    df = spark.createDataFrame([(5, "a"), (None, "b"), (9, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_groups(df).collect()} == {(5, 5), (None, 5), (9, 5)}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 400), (400, 500), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    expected = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in expected.description)
    names = [d[0] for d in expected.description]
    rows = sorted(str([dict(zip(names, r))[c] for c in columns]) for r in expected.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns and sorted(str([r[c] for c in columns]) for r in got.collect()) == rows and rows


def test_odd_and_empty_tables(spark, odd, labels):
    operators = {
        "substring": substring_dedup.dedup_digests,
        "bpe": lambda d: bpe.encode_digests(d, TOKENIZER),
        "bpe_table": lambda d: bpe.encode_table(d, TOKENIZER),
        "quality": lambda d: quality.scored(d, quality.fit(d, labels)),
        "media": matroska.media_digests,
        "language": langid.identified,
        "toxicity": lambda d: toxicity.scored(d, toxicity.fit(d, labels)),
        "exact": exact_dedup.exact_groups,
        "simhash": simhash.near_groups,
    }
    for name, f in operators.items():
        rows = f(odd).collect()
        assert len(rows) == odd.count(), name
        assert f(odd.limit(0)).count() == 0, name
    assert packing.packed(odd.limit(0)).count() == 0
    assert warc.audited(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert substring_dedup.dedup_texts(odd.limit(0)).count() == 0

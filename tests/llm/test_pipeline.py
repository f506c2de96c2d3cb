"""The pipeline's stages against brute force on the smallest documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cardloom.llm.shared import sifted, staged
from tests.llm.test_near_texts import shingles, similar
from tests.llm.test_operators import brute_components, brute_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(staged(stage(spark, out[-1], SF)))
    return out


def test_stages(spark, steps):
    docs, kept, single, near, cut, packed = steps
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash", "substring_dedup", "packing"]
    assert all(s.schema == docs.schema for s in steps[1:-1])
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert kept.count() >= 0.98 * docs.count()
    before, best = text(kept), {}
    for i, t in before.items():
        best.setdefault("".join(t.split()), []).append((-len(t), i))
    assert set(text(single)) == {min(v)[1] for v in best.values()}
    sets = {i: shingles(t) for i, t in text(single).items()}
    groups = brute_components([(i, i) for i in sets] + [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
    assert set(text(near)) == {i for i, c in groups.items() if i == c}
    windows = brute_windows(list(text(near).items()))
    for r in cut.collect():
        n, gone, _ = windows[r.doc_id]
        assert len(r.text.encode().split()) == n - gone and (not gone or r.n_chars == len(r.text))
    assert {r.doc_id for r in packed.collect()} == set(windows)
    assert sum(r.length for r in packed.collect()) == sum(n - g for n, g, _ in windows.values())


def test_run_is_the_stages(spark, steps):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(cp.run(spark, SF)) == rows(steps[-1])


def test_rows_go_and_not_ids(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = [f"word{i}" for i in range(60)]
    other = " ".join(reversed(words))
    near = " ".join([*words[:59], "changed"])
    rows = [(1, "a copied text", "en", "s", 1), (2, "a copied text", "en", "s", 1), (2, "a unique text", "en", "s", 1), (3, other, "en", "s", 1), (3, other, "en", "s", 1)]
    rows += [(None, "null ids", "en", "s", 1), (None, "null ids", "en", "t", 1), (4, " ".join(words), "en", "s", 1), (5, near, "en", "s", 1), (5, "shares an id with a near copy", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    left = staged(cp.exact(spark, docs, SF))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, "a copied text"), (2, "a unique text"), (3, other), (0, "null ids"), (4, " ".join(words)), (5, near), (5, "shares an id with a near copy")])
    for start in (docs, left):
        out = sorted((r.doc_id or 0, r.text) for r in cp.near(spark, start, SF).collect())
        assert out == sorted([(1, "a copied text"), (2, "a unique text"), (3, other), (0, "null ids"), (4, " ".join(words)), (5, "shares an id with a near copy")])


def test_nulls_and_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "same id", None, None, 7)], docs.schema)
    for start in (docs.limit(0), docs.limit(20).union(odd)):
        now = start
        for _, stage in cp.STAGES:
            now = staged(stage(spark, now, SF))
        assert now.columns[0] == "doc_id"


@pytest.mark.parametrize("stage", [cp.exact, cp.near])
def test_rows_that_surely_stay_are_not_shuffled(spark, stage):
    text = F.concat_ws(" ", *(F.sha2(F.concat_ws(":", F.col("id") % 900, F.lit(i)), 256) for i in range(8)))
    docs = spark.range(0, 1_000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stage(spark, docs, SF).select("doc_id", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in out) == list(range(900))
    # Copies of the first hundred texts follow at the end; the other texts are alone.
    alone = [r for r in out if r.doc_id >= 100]
    assert sum(r.at == r.doc_id // 250 for r in alone) >= 0.95 * len(alone)


@pytest.mark.parametrize("bits", [None, 64])
def test_a_sift_loses_no_key(spark, bits):
    keys = staged(spark.range(-500, 500).select((F.col("id") * 7).alias("key")))
    rows = spark.range(-7_000, 7_000)
    got = sifted(rows, F.col("id"), keys, bits=bits)
    assert got.count() == 14_000
    assert got.filter("maybe AND id % 7 = 0 AND id BETWEEN -3500 AND 3493").count() == 1_000
    if not bits:
        assert got.filter("maybe").count() < 1_100
    assert not sifted(rows, F.col("id"), staged(keys.limit(0))).filter("maybe").count()

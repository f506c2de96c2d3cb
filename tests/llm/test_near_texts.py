"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import itertools
import random

import pytest

import corpus_pipeline as cp
from cardloom.llm import near_texts
from tests.llm.test_operators import brute_components


def shingles(text):
    w = text.lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a and b else False


def test_near_stage_links_what_is_similar(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    single = cp.exact(spark, docs, "")
    sets = {r.doc_id: shingles(r.text or "") for r in single.collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b])]
    groups = brute_components([(i, i) for i in sets] + pairs)
    assert {(2, 56), (643, 770), (709, 944)} <= {tuple(sorted(p)) for p in pairs}
    assert {r.doc_id for r in cp.near(spark, single, "").collect()} == {i for i, c in groups.items() if i == c}


def test_bands_keep_their_chance():
    assert near_texts.bands_for(1) == near_texts.bands_for(4 << 20) == (16, 16)
    for n in (1, 10**7, 10**9, 10**11):
        prints, band = near_texts.bands_for(n)
        assert n / 2**band <= near_texts.SHARD or band == 16
        assert 1 - (1 - 0.8485**band) ** (prints * (64 // band)) > 0.989


@pytest.mark.parametrize(("cap", "bands"), [(512, None), (7, None), (512, (62, 21))])
def test_near_copies_of_one_text(spark, cap, bands, monkeypatch):
    if bands:
        monkeypatch.setattr(near_texts, "bands_for", lambda *_: bands)
    rng = random.Random(3)
    rows = {}
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 80, 400]))]
        for k in range(20):
            t = base.copy()
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(400)}"
            rows[g * 20 + k] = " ".join(t)
    sets = {i: shingles(t) for i, t in rows.items()}
    groups = brute_components([(i, i) for i in sets] + [p for p in itertools.combinations(sets, 2) if similar(sets[p[0]], sets[p[1]])])
    df = spark.createDataFrame(list(rows.items()), "node long, text string").repartition(4)
    found = [(r.a, r.b) for r in near_texts.links(df, cap=cap).collect()]
    assert all(similar(sets[a], sets[b]) for a, b in found)
    assert brute_components([(i, i) for i in sets] + found) == groups

"""What the pipeline's language stage keeps."""

import itertools

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_clean_short_and_mixed_texts_stay(spark, docs):
    words: dict[str, list[str]] = {}
    for r in docs.filter("n_chars > 300 AND lang IS NOT NULL").orderBy("doc_id").collect():
        words.setdefault(r.lang, []).extend(w for w in r.text.split() if w.strip(".,").isalpha())
    assert len(words) == 4
    of = lambda lang, at, n: " ".join(words[lang][at : at + n])
    texts = [of(lang, at, n) for lang in words for at in range(0, 800, 40) for n in (1, 2, 3)]
    texts += [f"{of(a, at, n)} {of(b, at, n)}" for a, b in itertools.permutations(words, 2) for at, n in ((0, 50), (300, 20))]
    texts += [f"{of(a, at, 40)} {of(b, at, 30)} {of(c, at, 30)}" for a, b, c in itertools.permutations(words, 3) for at in (0, 300)]
    texts += [" ".join(of(lang, at, 25) for lang in words) for at in range(0, 800, 100)]
    texts += ["De.", "Re."]
    odd = [None, "", "  \n", "123 !! 45", "日本語 の 文章 です", "Привет мир это текст", "これは 長い 日本語 の 文章 です ok"]
    rows = [(-1 - i, t, None, None, None) for i, t in enumerate(texts + odd)]
    out = {r.doc_id for r in cp.language_id(spark, docs.union(spark.createDataFrame(rows, docs.schema)), SF).filter("doc_id < 0").collect()}
    assert [t for i, t in enumerate(texts) if -1 - i not in out] == []
    assert [t for i, t in enumerate(odd, len(texts)) if -1 - i in out] == []


def test_only_what_has_no_letters_goes(spark, docs):
    kept = {r.doc_id for r in cp.language_id(spark, docs, SF).collect()}
    assert {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))} == kept

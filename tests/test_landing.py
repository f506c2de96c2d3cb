"""The landing sink and the source of pages."""

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from cardloom.sources import landing, recognise


class Pages:
    """Pages parted by form feeds; says so if it is asked for a page that nobody wants."""

    def __init__(self, most=99):
        self.most = most

    def page_texts(self, content):
        for n, text in enumerate(content.decode().split("\f"), 1):
            if n > self.most:
                raise AssertionError(f"page {n} was read")
            yield text


def landed(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def files(spark, pairs):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in pairs], "path string, content binary")


def test_files_land_once(spark, tmp_path):
    pairs = [(f"a b/{i}.pdf", b"x" * i) for i in range(40)]
    landing.land(files(spark, pairs).repartition(5), str(tmp_path))
    assert landed(tmp_path) == dict(pairs) and not list((tmp_path / "_landing").iterdir())
    landing.land(files(spark, pairs[:7]), str(tmp_path))  # again: they have landed
    landing.land(files(spark, [("more/y", b"")]), f"file://{tmp_path}")
    assert landed(tmp_path) == dict(pairs) | {"more/y": b""}
    landing.land(files(spark, []), str(tmp_path))


def test_clashes_are_reported_and_nothing_lands(spark, tmp_path):
    landing.land(files(spark, [("p/1", b"one")]), str(tmp_path))
    for pairs in ([("p/2", b"two"), ("p/1", b"other")], [("p/3", b"a"), ("p/3", b"b")]):
        with pytest.raises(Exception, match="land at p/3|clash"):
            landing.land(files(spark, pairs).repartition(1), str(tmp_path))
        with pytest.raises(Exception, match="clash|land at"):
            landing.land(files(spark, pairs).repartitionByRange(2, F.hex("content")), str(tmp_path))
    for bad in ("../x", "a//b", "_landing/x", "", None):
        with pytest.raises(Exception, match="not a path"):
            landing.land(files(spark, [(bad, b"")] if bad is not None else []) if bad is not None else spark.createDataFrame([(None, None)], "path string, content binary"), str(tmp_path))
    assert landed(tmp_path) == {"p/1": b"one"}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    def fails(batches):
        for batch in batches:
            yield batch
        if TaskContext.get().partitionId() == 1:
            raise RuntimeError("lost")

    df = files(spark, [(f"q/{i}", b"z") for i in range(20)]).repartition(3)
    with pytest.raises(Exception, match="lost"):
        landing.land(df.mapInArrow(fails, df.schema), str(tmp_path))
    assert landed(tmp_path) == {}


def test_pages_of_files_with_pushed_filters(spark, tmp_path):
    pairs = [(f"d{i % 3}/{i}.txt", "\f".join(f"{i}.{p}" for p in range(1, i % 5 + 2)).encode()) for i in range(20)] + [("bad.txt", b"\xff\xfe"), ("_hidden/x", b"no")]
    for path, content in pairs:
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "page_no", "text").collect()), key=str)
    all_pages = landing.card_pages(spark, str(tmp_path), Pages(), partition_bytes=20)
    assert all_pages.rdd.getNumPartitions() > 3
    seen = rows(all_pages)
    plain = recognise.pages(recognise.files(spark, str(tmp_path)).filter("path NOT LIKE '%_hidden%'"), Pages()).withColumn("doc_id", F.regexp_replace("doc_id", f"^.*{tmp_path.name}/", ""))
    assert seen == rows(plain) and [r.doc_id for r in all_pages.filter("error IS NOT NULL").collect()] == ["bad.txt"]
    # With a pushed bound no later page is read: `Pages(2)` would give errors.
    for condition, keep, most in (("page_no <= 2", {1, 2}, 2), ("page_no < 2", {1}, 1), ("page_no = 2", {2}, 2), ("page_no IN (1, 3) AND page_no <= 2", {1}, 2)):
        found = landing.card_pages(spark, f"file://{tmp_path}", Pages(most), partition_bytes=20).filter(condition)
        assert rows(found) == [r for r in seen if r[1] in keep]
    one = landing.card_pages(spark, str(tmp_path), Pages(), partition_bytes=1).filter("doc_id = 'd1/4.txt' AND text LIKE '%.3'")
    assert [r.text for r in one.collect()] == ["4.3"]
    assert landing.card_pages(spark, str(tmp_path / "none"), Pages()).count() == 0


def test_the_plan_has_no_filter_left(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1\f2\f3")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = landing.card_pages(spark, str(tmp_path), Pages())
    assert "BatchScan card_pages" in plan(found) and "Filter" not in plan(recognise.first_pages(found)).replace("RuntimeFilters", "")
    assert "Filter" in plan(found.filter("text = '1'")).replace("RuntimeFilters", "")

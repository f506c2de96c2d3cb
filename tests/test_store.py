"""The store of segments and manifests, and the streams that write to it."""

import os

import pytest
from pyspark.sql import functions as F

from cardloom.operators import records
from cardloom.plans import fixtures as X
from cardloom.streaming import accounts, ingest
from cardloom.streaming.store import Manifest, Store, Table, columns

SF = "/root/testdata/sf0.001"
TABLES = {"t": Table(columns("k int, v string"), key="k", bucket_by="k", number="k"), "log": Table(columns("v string"))}


def rows(df):
    return sorted(map(str, df.collect()))


def put(store, version, pairs, log=()):
    spark = store.spark
    return store.publish(version, {"t": store.write("t", spark.createDataFrame(pairs, "k int, v string"), version), "log": store.write("log", spark.createDataFrame([(x,) for x in log], "v string"), version)})


def folders(store, name):
    return {f"{name}/{v}/{s}" for v in os.listdir(f"{store.root}/{name}") for s in os.listdir(f"{store.root}/{name}/{v}")}


def test_newest_rows_show_and_levels_merge(spark, tmp_path):
    store = Store(spark, str(tmp_path), TABLES, fan=3, keep=2)
    with pytest.raises(FileNotFoundError):
        store.read("t")
    expected, log = {}, []
    for version in range(10):
        changed = {k: f"{k} of {version}" for k in range(version, 40, version + 1)}
        expected |= changed
        log.append(str(version))
        manifest = put(store, version, list(changed.items()), [str(version)])
        assert {r.k: r.v for r in store.read("t").collect()} == expected and store.read("t").count() == len(expected)
        assert sorted(r.v for r in store.read("log").collect()) == sorted(log)
        levels = [s["level"] for s in manifest.segments["t"]]
        assert levels == sorted(levels, reverse=True) and max(levels.count(x) for x in levels) < 3
    # Two versions can be read; what only older ones name is gone.
    assert store.versions() == [8, 9] and manifest.kept == [8, 9] and manifest.last["t"] == 39
    before = store.manifest(8)
    assert {r.k: r.v for r in store.read("t", before).collect()} != expected
    assert folders(store, "t") == {p for p in before.paths() | manifest.paths() if p.startswith("t/")}


def test_a_lookup_reads_its_bucket_only(spark, tmp_path):
    store = Store(spark, str(tmp_path), TABLES, buckets=8)
    put(store, 0, [(k, "x") for k in range(200)])
    bucket = spark.range(1).select(store.bucket(F.lit(7).cast("string"))).first()[0]
    found = store.read("t", buckets=[bucket])
    assert found.filter("k = 7").count() == 1 and found.count() < 200
    assert store.lookup("t", 7, "k").first().v == "x" and store.lookup("t", 999, "k").count() == 0
    # Of the folders of buckets only that one is read: the filter is on the partition and not on rows.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: []" in plan


def test_writers_of_one_version_do_not_mix(spark, tmp_path):
    one, two = Store(spark, str(tmp_path), TABLES), Store(spark, str(tmp_path), TABLES)
    put(one, 0, [(1, "a")])
    mine, other = one.write("t", spark.createDataFrame([(2, "mine")], "k int, v string"), 1), two.write("t", spark.createDataFrame([(2, "other")], "k int, v string"), 1)
    base = two.manifest()
    one.publish(1, {"t": mine})
    with pytest.raises(FileExistsError):
        two.publish(1, {"t": other}, base)
    assert {r.k: r.v for r in one.read("t").collect()} == {1: "a", 2: "mine"}
    assert one.vacuum() == 1 and {r.k: r.v for r in two.read("t").collect()} == {1: "a", 2: "mine"}


def test_a_manifest_is_its_text():
    m = Manifest(3, {"t": [{"path": "t/x", "version": 3, "level": 0, "rows": 2}]}, {"t": 9}, [2, 3])
    import json

    assert Manifest.of(json.dumps(m.__dict__)) == m and m.paths() == {"t/x"}


class Crash(Exception):
    pass


def test_stream_of_arrivals_with_a_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    src, when = str(tmp_path / "in"), F.to_timestamp(F.lit(X.ARRIVED))
    x = X.extractions(spark, SF).filter("arrival_seq < 1200")
    users, students, programs = X.users(spark, SF), X.students(spark, SF), X.programs(spark, SF)
    store = ingest.open_store(spark, str(tmp_path / "out"), students, programs, fan=2)
    listings, crashes = [], [1, 3]
    commit, listed = Store.commit, Store.versions

    def fails_once(self, manifest):
        if manifest.version in crashes:
            crashes.remove(manifest.version)
            raise Crash("between files and manifest")
        commit(self, manifest)

    monkeypatch.setattr(Store, "commit", fails_once)
    monkeypatch.setattr(Store, "versions", lambda self: listings.append(1) or listed(self))
    for i, (low, high) in enumerate(((0, 400), (400, 800), (800, 1200))):
        x.filter(f"arrival_seq >= {low} AND arrival_seq < {high}").coalesce(1).write.mode("append").parquet(src)
        for attempt in range(2):
            stream = spark.readStream.schema(x.schema).parquet(src)
            began = len(listings)
            query = ingest.consolidate_stream(stream, store, users, str(tmp_path / "cp"), uploaded=when, once=True)
            try:
                query.awaitTermination()
                assert len(listings) - began <= 1
                break
            except Exception as why:
                assert attempt == 0 and "between files and manifest" in str(why)
                assert store.manifest().version == i  # the broken batch doesn't show
    assert not crashes and store.manifest().version == 3
    whole = records.consolidate(x, users, students, programs, spark.createDataFrame([], "Id int"), when)
    for name in ("students", "programs", "documents"):
        assert rows(store.read(name).select(getattr(whole, name).columns)) == rows(getattr(whole, name))
    assert rows(store.read("rejected")) == rows(whole.rejected.select(store.read("rejected").columns)) != []
    # A batch that was published is skipped.
    ingest.apply_batch(store, users, when)(x, 2)
    assert store.manifest().version == 3
    # Only what a batch changed is written: fewer rows than there are students.
    delta = store.write("students", store.read("students").limit(1), 9)
    assert delta["rows"] == 1 and store.vacuum() >= 0
    assert rows(store.read("students").select(whole.students.columns)) == rows(whole.students)


def test_accounts_for_any_cut_and_with_restarts(spark, tmp_path):
    users = X.users(spark, SF)
    requests = [(i, f"user{i % 7 * 40}@example.org" if i % 11 else None, f"N{i}", None, "x") for i in range(60)]
    schema = "seq long, email string, name string, last_name string, password_hash string"
    expected = rows(records.register(spark.createDataFrame([r for r in requests if r[1]], schema), users))
    logins = [(f"user{i % 9}@example.org" if i % 5 else "nobody@example.org", i % 4 > 0) for i in range(80)]
    for n, cuts in enumerate(([60], [1, 2, 60])):
        store, counts = Store(spark, f"{tmp_path}/u{n}", accounts.USERS), Store(spark, f"{tmp_path}/c{n}", accounts.COUNTS)
        low = 0
        for high in cuts:
            spark.createDataFrame(requests[low:high], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r{n}")
            spark.createDataFrame(logins[low : high if high < 60 else 80], "email string, verified boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/l{n}")
            accounts.register_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/r{n}"), store, users, f"{tmp_path}/rc{n}", once=True).awaitTermination()
            accounts.count_stream(spark.readStream.schema("email string, verified boolean").parquet(f"{tmp_path}/l{n}"), counts, f"{tmp_path}/lc{n}", once=True).awaitTermination()
            low = high
        assert rows(store.read("users").select("Id", "Nombre", "Apellido", "Email", "Password", "ConteoIngresos")) == expected != []
        assert rows(accounts.counted(users, counts.read("logins"))) == rows(records.count_logins(users, spark.createDataFrame(logins, "email string, verified boolean")))


def test_a_batch_reaches_a_database_once(spark, tmp_path, monkeypatch):
    from cardloom.sources import database

    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    with database._transaction(spark, options) as c:
        database._run(c, 'CREATE TABLE documento ("Id" INT NOT NULL PRIMARY KEY, "Archivo" VARCHAR(255))')
    read = lambda: sorted(tuple(r) for r in spark.read.format("jdbc").options(**options, dbtable="documento").load().collect())
    batch = lambda a, b: spark.range(a, b, 1, 4).select(F.col("id").cast("int").alias("Id"), F.concat(F.lit("f"), "id").alias("Archivo"))
    expected = [(i, f"f{i}") for i in range(40)]
    assert database.publish(batch(0, 20), options, "documento", "Id", 1) == 20
    # A task that breaks: the others' rows don't reach the table, and the batch can be done again.
    breaking = batch(20, 40).withColumn("Archivo", F.when(F.col("Id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("Archivo")))
    with pytest.raises(Exception, match="lost"):
        database.publish(breaking, options, "documento", "Id", 2)
    assert read() == expected[:20]
    # Rows that a task has written twice count once.
    assert database.publish(batch(15, 40).union(batch(15, 40)), options, "documento", "Id", 2) == 20
    assert read() == expected
    assert database.publish(batch(20, 60), options, "documento", "Id", 2) == 0 and read() == expected
    # A crash in the transaction leaves neither rows nor the ledger's note.
    run = database._run
    monkeypatch.setattr(database, "_run", lambda c, q: 1 / 0 if q.startswith("INSERT INTO documento_batches") else run(c, q))
    with pytest.raises(ZeroDivisionError):
        database.publish(batch(40, 50), options, "documento", "Id", 3)
    monkeypatch.undo()
    assert read() == expected and database.publish(batch(40, 50), options, "documento", "Id", 3) == 10

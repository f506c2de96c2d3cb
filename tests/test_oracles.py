"""Every query that SQL can express against its SQL, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cardloom.plans import fixtures
from cardloom.plans.oracles import ORACLES
from cardloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "events", "lineitem", "orders", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(str([plain(v) for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(fixtures.FIXTURES))
def test_fixtures_are_the_same_in_both(spark, duck, name):
    make, sql = fixtures.FIXTURES[name]
    assert rows(make(spark, SF).toPandas()) == rows(duck.execute(sql).fetchdf())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, expected = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLES[name]).fetchdf())
    assert got == expected
    assert got[1]

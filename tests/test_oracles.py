"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidewake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


def test_each_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    found = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((plain([r[i] for i in order]) for r in found.fetchall()), key=repr)
    assert got == want

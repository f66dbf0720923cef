"""Every library query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from cloakframe.plans import catalog, engine, extended  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    res = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in res.fetchall()), key=repr)
    assert got == want

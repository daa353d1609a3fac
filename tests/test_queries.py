"""Every registered query against its SQL, on the driver's small tables."""

import os

import duckdb
import pytest

from leafmill.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables absent")


def norm(v):
    if v is None or v != v:
        return "~"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    r = duck.execute(q.sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert got == want


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

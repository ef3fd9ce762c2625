import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def normal(rows):
    return sorted(tuple("null" if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, views, name):
    df = entry.queries()[name](spark, FOLDER)
    found = views.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = normal(found.fetchall())
    got = normal(tuple(r) for r in df.select(*columns).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(abs(x - y) <= 1e-6 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(g, w))

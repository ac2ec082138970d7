"""Every query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import flows  # noqa: F401 (adds its queries)
from millrace.plans import queries as own

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return str(list(map(plain, x))) if isinstance(x, list) else str(x)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    frame = own.QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    if name not in own.SQL:
        assert rows
        return
    result = duck.execute(own.SQL[name])
    there = [c[0] for c in result.description]
    assert sorted(there) == names
    assert rows == sorted(tuple(plain(r[there.index(c)]) for c in names) for r in result.fetchall())


def test_entry_names_are_complete():
    import __spark_entry__ as entry

    every = entry.queries()
    assert set(own.QUERIES) <= set(every) and set(entry.oracle_sql()) <= set(every)

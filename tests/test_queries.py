"""Every registered query at the smallest scale, against its SQL form where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "__float__") and not isinstance(v, str):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    names = sorted(map(str, frame.columns))
    return names, [tuple(map(plain, r)) for r in frame[names].itertuples(index=False)]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(ROOT):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, ROOT).toPandas()
    if text := entry.oracle_sql().get(name):
        names, found = rows(got)
        other, expected = rows(duck.sql(text).df())
        assert names == other
        key = lambda r: tuple(x or "" for x in r)
        assert sorted(found, key=key) == sorted(expected, key=key)


def test_entry(spark):
    assert entry.entry(spark).columns == ["url", "title", "description", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

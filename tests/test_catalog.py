"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    r = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    ours = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

"""Every query with oracle SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from trackloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def close(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4 * max(1, abs(x)) for x, y in zip(a, b))


def key(row):
    """Exact columns first, so that rounding does not change the order of rows that they tell apart."""
    return [str(v) for v in row if not isinstance(v, float)], [v for v in row if isinstance(v, float)]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = [tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall()]
    if sorted(map(repr, got)) != sorted(map(repr, want)):
        assert len(got) == len(want)
        assert all(close(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key)))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0

"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from camtrap_spark import oracles, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "part", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else str(round(value, 9) + 0.0)
    return None if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    found = duck.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_entry(spark):
    assert 400 < entry.entry(spark).count() <= 500  # sf0.001 has fewer bursts than slots
    assert set(queries.queries()) <= set(entry.queries())

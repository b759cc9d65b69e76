"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from bindery.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    rows = got.collect()
    assert rows
    sql = catalog.oracle_sql().get(name)
    if not sql:
        return
    want = duck.sql(sql)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    place = [want.columns.index(c) for c in columns]
    left = sorted((repr(tuple(value(r[c]) for c in columns)) for r in rows))
    right = sorted(repr(tuple(value(r[k]) for k in place)) for r in want.fetchall())
    assert left == right


def test_names_of_the_oracles():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())

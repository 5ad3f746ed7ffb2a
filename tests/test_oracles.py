"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF_DIR, TABLES

import __spark_entry__ as entry_module
from doclake.plans.oracles import ORACLES
from doclake.plans.registry import QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def normal(rows):
    def cell(value):
        return round(value, 6) if isinstance(value, float) else value

    out = [tuple(cell(v) for v in row) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(type(v)), 0 if v is None else v) for v in row))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    expected = [tuple(row[found.index(c)] for c in columns) for row in cursor.fetchall()]
    actual = [tuple(r) for r in df.select(*columns).collect()]
    assert len(expected) > 0
    assert normal(actual) == normal(expected)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0

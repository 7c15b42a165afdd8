"""Each query against the same in SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sparkloom.plans.queries import ORACLE_SQL, QUERIES


def same(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(same, r)) for r in df.select(*columns).collect())
    cursor = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(same(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0

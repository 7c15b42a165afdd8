"""Corpus queries against the same in SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))

"""Every registered query against its independent SQL, on whole small tables."""

import math
import os

import duckdb
import pytest

from rewardloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(root):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{root}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, root, duck, name):
    df = QUERIES[name](spark, root)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, df.collect()) == canonical(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, root, name):
    assert QUERIES[name](spark, root).count() > 0

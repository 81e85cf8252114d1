"""Every query with SQL gives the rows of that SQL."""

import math
import os

import duckdb
import pytest

from colonnade.plans.catalog import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    relation = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({SQL[name]})")
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_others_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0

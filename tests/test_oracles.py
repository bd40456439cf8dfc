"""Every registered query with SQL gives what DuckDB gives, at the smallest scale."""

import os

import duckdb
import pytest

from lodeframe.plans.registry import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"
SLOW = {"chunk_markdown_sections"}


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in sql), key=repr)


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0

"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    return None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    rel = duck.sql(SQL[name])
    assert columns == sorted(rel.columns)
    theirs = sorted((tuple(plain(v) for v in r) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert mine == theirs


def test_every_raster_query_has_sql():
    from rastermill.plans.queries import QUERIES

    assert {*QUERIES} <= {*SQL}

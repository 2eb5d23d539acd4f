"""Every registered raster query against its SQL on DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans.queries import QUERIES, SQL

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in got.columns]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())

"""Ids over rasters of more lines than a frame has: at sf0.01 a line number's rows fill more than one frame."""

import duckdb
import pytest

from tessera.plans.queries import QUERIES, SQL

LARGER = "/root/testdata/sf0.01"


def against_sql(spark, name):
    """The query's rows and its SQL's, sorted."""
    got = QUERIES[name](spark, LARGER)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{LARGER}/lineitem.parquet')")
    found = c.execute(SQL[name])
    at = [[d[0] for d in found.description].index(x) for x in got.columns]
    return sorted(map(tuple, got.collect())), sorted(tuple(r[i] for i in at) for r in found.fetchall())


@pytest.fixture(scope="module")
def labels():
    """Every label of the undivided rasters, made from the rows with no CTE of the library."""
    rows = duckdb.connect().execute(f"""
        WITH p AS (SELECT l_quantity AS q, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS p
                   FROM '{LARGER}/lineitem.parquet')
        SELECT DISTINCT (p // 64 // 8) * 8 + p % 64 // 8 + CAST(floor(q) > 45 AS INT) FROM p""").fetchall()
    return sorted(r[0] for r in rows)


def test_distinct_ids_of_all_frames(spark, labels):
    got, want = against_sql(spark, "distinct_ids")
    assert got == want == [(k,) for k in labels if k >= 20]
    assert len(got) == 117  # the labels of one frame are 109 of them


def test_compact_ids_of_all_frames(spark, labels):
    got, want = against_sql(spark, "compact_ids")
    assert got == want == [(k, 20 + r) for r, k in enumerate(3 * k + 1 for k in labels if 3 * k + 1 >= 20)]
    assert len(got) == 130


def test_factorize_of_all_frames(spark, labels):
    got, want = against_sql(spark, "factorize")
    assert got == want and [k for k, _ in got] == labels
    assert sorted(c for _, c in got) == list(range(137))


def test_factorize_with_labels_first_seen_in_a_short_last_frame(spark):
    """The first raster's second frame is one short line of the larger of two line numbers: its labels come before those of the second raster."""
    from tessera.operators import regions
    from tessera.plans.pixels import HEIGHT, TURNS, whole

    rows = [(0, 0, 0, 0), (0, HEIGHT - 1, 63, 127), (TURNS, 0, 0, 0), (TURNS, 0, 9, 1), (1, 0, 0, 1), (1, 8, 0, 8)]
    p = spark.createDataFrame(rows, "t int, y int, x int, spix int")
    assert sorted(map(tuple, whole(p).collect())) == [(0, 0, 0, 0), (0, 127, 63, 127), (0, 128, 0, 128), (0, 128, 9, 129), (1, 0, 0, 1), (1, 8, 0, 8)]
    assert {r.spix: r.code for r in regions.factorize(whole(p)).collect()} == {0: 0, 127: 1, 128: 2, 129: 3, 1: 4, 8: 5}

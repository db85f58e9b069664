"""Registered voxel queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from voxlake.jobs import queries as voxel

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return order, sorted(repr(tuple(r[k] for k in at)) for r in found)


@pytest.mark.parametrize("name", sorted(voxel.ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = voxel.QUERIES[name](spark, small)
    want = duck.execute(voxel.ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_no_bright_voxel_counts_as_zero(spark, tmp_path):
    """All voxels alike, as on large tables: none is above one and a half times the mean."""
    lines = spark.range(64).selectExpr("id % 2 as l_suppkey", "id % 4 as l_partkey", "id % 8 as l_orderkey", "1.0D as l_quantity")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(voxel.ORACLE_SQL["components_count"]).fetchall()
    assert want == [(0, 0)]
    assert [tuple(r) for r in voxel.QUERIES["components_count"](spark, str(tmp_path)).collect()] == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

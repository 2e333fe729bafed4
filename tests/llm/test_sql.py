"""Queries of this package against their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from lexloom.llm import queries

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(want.select(", ".join(columns)).fetchall())

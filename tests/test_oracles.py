"""Every query that has SQL, against DuckDB on the same tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def cell(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(cell, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    rows = Counter(tuple(map(cell, r)) for r in got.select(columns).collect())
    expected = Counter(tuple(map(cell, r)) for r in want.fetchall())
    assert rows == expected and sum(rows.values()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

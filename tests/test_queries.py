"""Every warehouse query against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import streamloom.job_queries  # noqa: F401  adds the jobs
from streamloom.catalogue import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    near = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr([near(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    frame = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, found.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with SQL against DuckDB at the smallest scale; every other one runs."""

import glob
import math
import os

import duckdb
import pytest

from rasterloom.plans import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.9g}"
        return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v) if v is not None else None

    def alike(v):
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else one(v)

    return sorted((tuple(alike(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0

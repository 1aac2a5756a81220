"""Every registered query against its SQL twin (DuckDB) at sf0.001; smoke for the rest."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from colscope.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 4))
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(entry_mod.queries()))
def test_query(spark, con, name):
    df = entry_mod.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    oracle = entry_mod.oracle_sql().get(name)
    if oracle is None:
        assert len(rows) > 0
        return
    con.sql(oracle).create_view("twin", replace=True)  # as the driver stores it
    res = con.execute("SELECT * FROM twin")
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _digest(rows, df.columns) == _digest(orows, ocols)

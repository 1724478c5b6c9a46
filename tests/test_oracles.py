"""Every registered query of the library against its SQL equivalent on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from coweave.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[[cell(x) for x in table[n].to_pylist()] for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    got = rows(QUERIES[name](spark, sf).toArrow())
    want = duck.sql(ORACLES[name])
    want = rows(want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.fetch_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())

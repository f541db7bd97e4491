"""Every query with a DuckDB equivalent gives the same rows; the others give some."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF).startswith(("ok", "rows only"))


def test_entry(spark):
    assert entry.entry(spark).count() == 3

"""Every profiler query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarrylens import queries

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return ""
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, TABLES).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours) == comparable(theirs)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 11


def test_examples_orders_gives_whole_rows(spark, duck):
    shown = queries.queries()["examples_orders"](spark, TABLES)
    assert shown.columns == [r[0] for r in duck.execute("DESCRIBE orders").fetchall()] and shown.count() == 20
    assert [r["o_orderkey"] for r in shown.collect()] == [r[0] for r in duck.execute("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20").fetchall()]

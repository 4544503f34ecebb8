"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidegraph.plans import oracle
from tidegraph.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_all_have_sql():
    assert set(QUERIES) - set(oracle.SQL) == {"kway_cut"}  # its split is one of many
    assert set(oracle.SQL) <= set(QUERIES)
    assert set(oracle.SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(oracle.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    tidy = lambda df: df[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert tidy(got).equals(tidy(want))


def test_graphs_have_every_row(spark, duck):
    from tidegraph.plans import recipes

    n = lambda sql: duck.sql(sql).df().iloc[0, 0]
    assert recipes.link(spark, DATA).count() == n("SELECT count(*) FROM orders")
    assert recipes.trade(spark, DATA).count() == n("SELECT count(*) + count(*) FILTER (l_returnflag = 'R') FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    assert recipes.dense(spark, DATA).count() == n("SELECT count(*) - 1 FROM orders")


def test_scan_keeps_all_lines(spark, duck):
    """Over 1,000 valid lines are all kept, as the reference does up to 250,000."""
    got = QUERIES["scan_edgelist"](spark, DATA).count()
    assert got == duck.sql("SELECT count(*) FROM orders WHERE o_custkey % 11 NOT IN (3, 4, 5)").df().iloc[0, 0] > 1000


def test_kway_holds_its_cut(spark, monkeypatch):
    """A split of even sizes that cuts more than its starting ranges isn't passed as balanced."""
    from tidegraph.plans import queries as Q

    path = spark.createDataFrame([(i, i + 1) for i in range(29)], "src long, dest long")
    assert Q._kway(path).first().balanced
    monkeypatch.setattr(Q.S, "kway", lambda g, k: Q.recipes.thirds(g))
    assert not Q._kway(path).first().balanced

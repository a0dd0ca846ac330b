"""Every query against its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW = {"pipeline"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9) + 0.0
        df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    mine, theirs = plain(QUERIES[name](spark, sf_dir).toPandas()), plain(db.execute(ORACLES[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.equals(theirs)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("op") and n not in SLOW))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["drifted_boxes", "reviewed"])
def test_lines_of_the_same_numbers_are_boxes_of_their_own(spark, tmp_path, name):
    lines = [(1, 2, 3, n, q, 0.0, tax, "N") for n, q, tax in ((0, 43.0, 0.05), (0, 19.0, 0.05), (0, 19.0, 0.05), (2, 1.0, 0.0), (2, 1.0, 0.08), (9, 5.0, 0.01))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5e5), (2, 5.0)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    mine, theirs = plain(QUERIES[name](spark, str(tmp_path)).toPandas()), plain(con.execute(ORACLES[name]).df())
    assert len(theirs) > 0 and mine.equals(theirs[list(mine.columns)])


def test_entry(spark):
    assert entry.entry(spark).count() == 4

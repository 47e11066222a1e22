"""Comparison of a query with its SQL over a directory of Parquet tables."""

import glob
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{files}')")
    return con


def same(df, con, sql):
    cursor = con.execute(sql)
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(str(tuple(r[c] for c in order)) for r in df.collect())
    theirs = sorted(str(tuple(r[columns.index(c)] for c in order)) for r in cursor.fetchall())
    assert mine == theirs
